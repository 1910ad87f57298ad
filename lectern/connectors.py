"""Language models behind HTTP: clients for the plug points, and one that turns to a second.

A client is made by a factory that travels to the tasks (see ``plugins.complete``). It takes a
prompt, with an optional system text, and gives the reply; ``stream`` gives it in pieces.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from lectern.functions.replies import without_thinking


class CallFailed(RuntimeError):
    """A call without a usable reply; ``second`` says whether another model may be asked."""

    def __init__(self, message: str, second: bool):
        super().__init__(message)
        self.second = second


def worth_a_second(status: int) -> bool:
    """Trouble of the server's, or too much at once, but not a bad request."""
    return status in (408, 429) or status >= 500


def _open(url: str, body: dict | None, headers: dict[str, str], timeout: float):
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers})
    try:
        return urllib.request.urlopen(request, timeout=timeout)
    except urllib.error.HTTPError as e:
        raise CallFailed(f"{url}: status {e.code}", worth_a_second(e.code)) from e
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise CallFailed(f"{url}: {e}", True) from e


@dataclass
class Model:
    """One model of a server. ``dialect`` is that of the server's interface: ``chat`` (messages to
    /api/chat, a JSON object a line) or ``completions`` (/v1/chat/completions, server-sent events)."""

    url: str
    model: str
    dialect: str = "chat"
    key: str = ""
    timeout: float = 120.0
    options: dict = field(default_factory=dict)

    def _call(self, messages: list[dict[str, str]], stream: bool, as_json: bool):
        body = {"model": self.model, "messages": messages, "stream": stream}
        if self.dialect == "chat":
            body |= {"options": self.options} | ({"format": "json"} if as_json else {})
            path = "/api/chat"
        else:
            body |= self.options | ({"response_format": {"type": "json_object"}} if as_json else {})
            path = "/v1/chat/completions"
        return _open(self.url.rstrip("/") + path, body, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.timeout)

    def chat(self, messages: list[dict[str, str]], as_json: bool = False) -> str:
        with self._call(messages, False, as_json) as reply:
            try:
                found = json.load(reply)
                text = found["message"]["content"] if self.dialect == "chat" else found["choices"][0]["message"]["content"]
            except (ValueError, LookupError, TypeError) as e:
                raise CallFailed(f"{self.url}: a reply that is none", False) from e
        return "".join(without_thinking([text or ""])).strip()

    def stream(self, messages: list[dict[str, str]]) -> Iterator[str]:
        def pieces() -> Iterator[str]:
            with self._call(messages, True, False) as reply:
                for raw in reply:
                    line = raw.decode("utf-8", "replace").strip()
                    if self.dialect != "chat":
                        if not line.startswith("data:") or line == "data: [DONE]":
                            continue
                        line = line.removeprefix("data:")
                    if not line.strip():
                        continue
                    found = json.loads(line)
                    if "error" in found:
                        raise CallFailed(f"{self.url}: {found['error']}", True)
                    yield (found.get("message", {}) if self.dialect == "chat" else found["choices"][0]["delta"]).get("content") or ""

        return without_thinking(pieces())

    def names(self) -> list[str]:
        """Models that the server has."""
        path, rows, name = ("/api/tags", "models", "name") if self.dialect == "chat" else ("/v1/models", "data", "id")
        with _open(self.url.rstrip("/") + path, None, {}, self.timeout) as reply:
            return [m[name] for m in json.load(reply)[rows]]


@dataclass
class Pair:
    """Two models, of which the second is asked where the first fails in a way that is worth it.
    A stream can change over only before its first piece."""

    first: Model
    second: Model

    def _either(self, call: Callable[[Model], object]):
        try:
            return call(self.first)
        except CallFailed as e:
            if not e.second:
                raise
            try:
                return call(self.second)
            except CallFailed as f:
                raise CallFailed(f"{e}; then {f}", False) from f

    def chat(self, messages: list[dict[str, str]], as_json: bool = False) -> str:
        return self._either(lambda m: m.chat(messages, as_json))

    def stream(self, messages: list[dict[str, str]]) -> Iterator[str]:
        def begin(m: Model) -> tuple[str, Iterator[str]]:
            pieces = m.stream(messages)
            return next(pieces, ""), pieces

        first, rest = self._either(begin)
        yield first
        yield from rest


def asker(model: Model | Pair, system: str = "", as_json: bool = False) -> Callable[[], Callable[[str], str]]:
    """A client factory for ``plugins.complete``."""

    def make() -> Callable[[str], str]:
        lead = [{"role": "system", "content": system}] if system else []
        return lambda prompt: model.chat([*lead, {"role": "user", "content": prompt}], as_json)

    return make

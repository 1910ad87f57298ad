"""Language ID by compression.

A text, in lower case, is compressed once with each language's zstandard raw-content dictionary,
in segments of ``segment_chars`` characters that each meet the dictionary afresh. The language
whose dictionary gives the fewest bytes over all segments wins, and a decision whose margin over
the runner-up is too narrow, as a share of the compressed bytes, is marked as rejected. Both
grow with the text, so the length of a text alone never rejects it.

Defined cases. Null text, or a text without any letter: ``und``, score 0, rejected.
Equal sizes: the language with more training rows, then the smaller name; margin 0.
Repeated rows are judged alike, row by row. An empty table gives an empty result; with no
training rows at all every row is ``und``. Very long texts are judged by all their segments. Other
columns of the input, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
RESULT = T.StructType([
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("margin", T.LongType()),
    T.StructField("rejected", T.BooleanType()),
])


@dataclass(frozen=True)
class Settings:
    """``sample_docs`` texts of at most ``sample_chars`` characters a language bound what
    training reads to the driver; ``dict_bytes`` bounds each dictionary. ``min_margin`` is
    the least difference in bytes, as a share of the winner's compressed bytes, that is not
    narrow: strings of random letters mostly stay below it, texts of a language far above."""

    sample_docs: int = 400
    sample_chars: int = 2000
    dict_bytes: int = 64 * 1024
    level: int = 6
    segment_chars: int = 8192
    min_margin: float = 0.01


def fit(labelled: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[tuple[str, bytes]]:
    """Dictionaries of the languages, most frequent first.

    Counts cover all labelled rows. The dictionary content is a bounded sample: rows are
    kept by a hash of the key, at a rate set from the language's count.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    rate = F.create_map([x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, settings.sample_docs / n)))])
    unit = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(unit < rate[F.col("l")]).select("l", "h", F.substring("t", 1, settings.sample_chars).alias("t")).collect()
    content: dict[str, bytearray] = {k: bytearray() for k in counts}
    for r in sorted(picked, key=lambda r: (r["h"], r["t"])):
        if len(content[r["l"]]) < settings.dict_bytes:
            content[r["l"]] += (r["t"].lower() + "\n").encode()
    # far matches cost more bits, so dictionaries of unequal length would not be fair
    size = min(settings.dict_bytes, max(4096, min(map(len, content.values()))))
    return [(k, bytes(content[k][:size])) for k in sorted(counts, key=lambda k: (-counts[k], k)) if len(content[k]) >= 8]


class Classifier:
    def __init__(self, model: list[tuple[str, bytes]], settings: Settings):
        self.names, self.settings, self.packers = [k for k, _ in model], settings, []
        for _, content in model:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=settings.level)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, level=settings.level, write_content_size=False, write_dict_id=False, write_checksum=False))

    def __call__(self, text: str | None) -> tuple[str, float, int, bool]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0, True
        text, step = text.lower(), self.settings.segment_chars
        segments = [text[i : i + step].encode("utf-8", "replace") for i in range(0, len(text), step)]
        sizes = [sum(len(p.compress(x)) for x in segments) for p in self.packers]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0, 0, False
        margin = min(s for i, s in enumerate(sizes) if i != best) - sizes[best]
        return self.names[best], min(1.0, margin / sizes[best]), margin, margin < self.settings.min_margin * sizes[best]


def judge(text: Column, model: list[tuple[str, bytes]], settings: Settings = Settings()) -> Column:
    """A struct column (lang_pred, score, margin, rejected) for ``text``. The model travels
    with the task; its size is at most languages times ``dict_bytes``."""
    made: list[Classifier] = []

    @F.pandas_udf(RESULT)
    def predict(batch: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Classifier(model, settings))
        return pd.DataFrame([made[0](t) for t in batch], columns=RESULT.names)

    return predict(text)

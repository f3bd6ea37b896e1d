"""Language identification by compression.

A dictionary of raw text is put together for each language from a bounded sample of labelled
documents. A lower-cased text is compressed, block by block and whole, with each language's zstandard raw
dictionary; the language that makes it smallest is chosen. A narrow margin over the runner-up
rejects the choice.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import add_columns, numbered, renamed, resident

#: The training sample: documents of each language, the most characters that these have, and languages. Bounds what the driver sees.
SAMPLE_DOCS, SAMPLE_CHARS, MOST_LANGUAGES = 128, 3000, 200
#: Languages with that many bytes in the sample get equal shares.
FLOOR = 64_000
#: Blocks stay short against the dictionary, so that a long text leans on it to its end.
BLOCK = 16384
LEVEL = 6
#: Share of the runner-up's size that the winner must save.
MIN_MARGIN = 0.002
UNKNOWN = "und"
RESULT = "lang_pred string, score double, margin double, rejected boolean"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, languages: int = MOST_LANGUAGES) -> list[tuple[str, bytes]]:
    """A raw dictionary for each language, the language with most documents first.

    It holds whole texts: of `docs` documents of at most `chars` characters, the first in the order of a
    hash of their id, or the one first document if none is so short. The `languages` languages with most
    documents are learnt. Of those with FLOOR bytes or more, each gets documents until it has as many
    bytes as the poorest of them, or else size alone would win; poorer ones have all that there is.

    Held-out documents, and those without a text or a language, teach nothing. Rows that repeat an id
    count one by one, in the order of their texts. No labelled row: no languages, and every text is then unknown.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    usable = rows.filter(~held_out("id") & F.col("lang").isNotNull() & (F.trim("text") != ""))
    count = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    long_ = F.length("text") > chars
    order = W.partitionBy("lang").orderBy("long", F.xxhash64("id"), "id", "text")
    # the ranks are cut within each task before anything shuffles
    ranked = usable.filter(F.col("lang").isin(list(count))).select("lang", "id", "text", long_.alias("long")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= docs)
    texts: dict[str, list] = {lang: [] for lang in count}
    for r in sorted(ranked.filter("NOT long OR n = 1").collect(), key=lambda r: (r["lang"], r["n"])):
        texts[r["lang"]].append(r["text"].lower().encode("utf-8"))
    size = min((s for s in (sum(map(len, t)) for t in texts.values()) if s >= FLOOR), default=FLOOR)
    out = []
    for lang, every in texts.items():
        had = 0
        for n, text in enumerate(every, 1):
            had += len(text)
            if had >= size:
                break
        out.append((lang, b"\n".join(every[:n])))
    return out


def compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return made


def identify(text: str | None, models: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, float]:
    """The language, a score from 0 to 1 and the margin. Ties go to the language with most documents."""
    if not text or not models or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0
    raw = text.lower().encode("utf-8")
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), i) for i, (_, c) in enumerate(models))
    margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
    return models[sizes[0][1]][0], margin / (margin + 0.01), margin


def predict(df: DataFrame, dictionaries: list[tuple[str, bytes]], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """df with lang_pred, score, margin and rejected. Columns with these names are replaced.

    NULL texts and those without a letter are `und`, rejected with score 0. Repeated rows get equal
    answers. With a single learned language every text is it. Of languages that make a text equally
    small the one with most documents is named, with margin and score 0, so rejected.
    """
    models = tuple(dictionaries)  # a few hundred kB, sent with the function

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        made = resident("langid", models, lambda: compressors(models))
        got = [identify(t, made) for t in batch.column(0).to_pylist()]
        langs, scores, margins = (list(c) for c in zip(*got)) if got else ([], [], [])
        rejected = [lang == UNKNOWN or m < min_margin for lang, m in zip(langs, margins)]
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())]

    return add_columns(df, run, RESULT, [text_col])


def identify_documents(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and rejected of every document."""
    return predict(df.select("doc_id", held_out().alias("held_out"), "text"), train(df)).drop("text")


def keep_identified(df: DataFrame) -> DataFrame:
    """The documents whose language isn't rejected, with their own columns, of any names; NULL, empty and letterless texts go.

    Repeated rows go or stay together. No row of an empty table.
    """
    rows, (text,) = numbered(df, "text")
    return renamed(predict(rows, train(df), text).filter("NOT rejected"), df.columns)

"""Language of a text by compression: the language whose dictionary makes it smallest.

Each language has a raw-content zstandard dictionary of its own words, the most common ones last, where matches are
cheapest. Texts are reduced to lower-case letters, cut in chunks, and each chunk is encoded with every dictionary; the
language with the smallest sum of sizes wins. Where the best is hardly smaller than the second, the text is rejected:
it keeps its best guess, and ``rejected`` says that it is no more than a guess.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import fresh, quoted

#: Labelled texts a language's words are counted in, the first by a hash of the id, and its dictionary's bytes.
SAMPLE = 4096
DICTIONARY = 32768
#: A model holds one dictionary per language; more languages are an error, never cut.
LANGUAGES = 1000
CHUNK = 1024
#: Chunks shorter than this are repeated up to it: zstandard stores what it can't shrink, which tells nothing.
LEAST = 256
LEVEL = 6
MARGIN = 0.01
UNDETERMINED = "und"
FOLDS, HELD_OUT = 3, 1
_PARTS = 1 << 30


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def letters(text: Column) -> Column:
    """Lower-case words of letters (and marks on them), one blank between; null or empty where there is none."""
    return F.when(text.rlike(r"\p{L}"), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionaries by language, the language with most training texts first.

    Only texts with a letter and a language outside the held-out fold are read. A language's words are counted in at
    most ``sample`` of its texts (rows are first thinned by the hash to about twice that, so no task gets all rows of
    a common language), by the number of texts that hold them; ties go by the word. What is collected is the words
    that fit a dictionary.
    """
    rows = (docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                        F.col(text_col).alias("text"), fold(id_col).alias("fold"))
            .where(F.col("lang").isNotNull() & (F.col("fold") != HELD_OUT) & F.col("text").rlike(r"\p{L}"))
            .withColumn("place", F.xxhash64("id", "lang")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return {}
    known = docs.sparkSession.createDataFrame([(r.lang, r.n) for r in counts], "lang string, n long")
    thin = (rows.join(F.broadcast(known), "lang")
            .where(F.pmod("place", F.lit(_PARTS)) * F.col("n") < 2 * sample * _PARTS))
    first = Window.partitionBy("lang").orderBy("place", "id", "text")
    words = (thin.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample)
             .select("lang", F.explode(F.array_distinct(F.split(letters(F.col("text")), " "))).alias("word"))
             .groupBy("lang", "word").agg(F.count("*").alias("texts")))
    best = Window.partitionBy("lang").orderBy(F.desc("texts"), "word")
    held = (words.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size // 2)
            .withColumn("bytes", F.sum(F.octet_length("word") + 1).over(best)).where(F.col("bytes") <= size)
            .select("lang", "rank", "word").collect())
    by = {r.lang: [] for r in sorted(counts, key=lambda r: (-r.n, r.lang))}
    for r in sorted(held, key=lambda r: -r["rank"]):
        by[r.lang].append(r.word)
    return {lang: " ".join([*words, ""]).encode() for lang, words in by.items()}


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    given = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=2 * CHUNK,
                                                           min_match=3, **plain)
    if not content:
        return zstandard.ZstdCompressor(compression_params=given)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=given)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=given)


def chunks(text: bytes) -> list[bytes]:
    """The whole text in chunks; short ones, a text's last included, repeated."""
    out = []
    for i in range(0, len(text), CHUNK):
        part = text[i:i + CHUNK]
        out.append(part if len(part) >= LEAST else b" ".join([part] * (LEAST // (len(part) + 1) + 1)))
    return out


def choose(sizes: list[int], margin: float = MARGIN) -> tuple[int, float, bool]:
    """(place of the smallest, score, rejected); of equal sizes the first counts. The score is the share by which
    the second is larger, 1 where there is no second."""
    best = min(range(len(sizes)), key=lambda i: sizes[i])
    second = min((x for i, x in enumerate(sizes) if i != best), default=None)
    score = 1.0 if second is None else 1.0 - sizes[best] / second
    return best, score, score < margin


def _identifier(dictionaries: dict[str, bytes], margin: float):
    names = list(dictionaries)

    def run(batches):
        encode = [compressor(x).compress for x in dictionaries.values()]
        for batch in batches:
            found = []
            for text in batch.column("letters").to_pylist():
                if not text or not encode:
                    found.append((UNDETERMINED, 0.0, True))
                    continue
                parts = chunks(text)
                best, score, rejected = choose([sum(len(e(p)) for p in parts) for e in encode], margin)
                found.append((names[best], score, rejected))
            lang, score, rejected = zip(*found) if found else ((),) * 3
            kept = [c for c in batch.schema.names if c != "letters"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(rejected, pa.bool_())], [*kept, "lang_pred", "score", "rejected"])
    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1), rejected.

    A null text, one without a letter and any text without a learned language is ``und`` with score 0, rejected. Of
    equally small sizes the language with more training texts wins, with score 0, rejected. Very long texts are
    encoded whole, chunk by chunk. Equal texts get equal results, repeated rows a row each, an empty table none.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == HELD_OUT).alias("held_out"),
                       letters(F.col(text_col)).cast("binary").alias("letters"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_identifier(dictionaries, margin),
                           f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``identify`` with dictionaries learned from the same table, outside the held-out fold."""
    return identify(docs, learn(docs, id_col, text_col, lang_col), id_col=id_col, text_col=text_col)


def keep_language(docs: DataFrame, dictionaries: dict[str, bytes], wanted: list[str], margin: float = MARGIN,
                  text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected or of another language than ``wanted``; all columns stay."""
    found = [fresh(docs, x) for x in ("letters_", "found_")]
    names = list(dictionaries)

    def accepted(text: pa.Array) -> pa.Array:
        encode = [compressor(x).compress for x in dictionaries.values()]
        out = []
        for t in text.to_pylist():
            if not t or not encode:
                out.append(False)
                continue
            best, _, rejected = choose([sum(len(e(p)) for p in chunks(t)) for e in encode], margin)
            out.append(not rejected and names[best] in wanted)
        return pa.array(out, pa.bool_())

    return (docs.withColumn(found[0], letters(F.col(text_col)).cast("binary"))
            .withColumn(found[1], F.arrow_udf(accepted, "boolean")(F.col(found[0])))
            .where(F.col(found[1])).select(*map(quoted, docs.columns)))

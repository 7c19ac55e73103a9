"""Encoding of a corpus with a public tokenizer.

For the byte-level tokenizers a text is first cut into words by the tokenizer's own pattern, on the
JVM. The most frequent words of the corpus are compiled with their ids into a minimal acyclic
transducer (:mod:`parchmint.llm.lexicon`) that every worker maps into memory; other words are
merged exactly, piece by piece, by the tokenizer itself. The lexicon only saves work: ids do not
depend on which words it holds.

The lexicon's size is bounded by ``lexicon_words``, a parameter of the model and not of the data.
Texts with characters that the JVM's Unicode version does not know are cut and merged by the
tokenizer alone, so a newer version on its side cannot change the cut.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.lexicon import Lexicon, compile_words, packed
from parchmint.staging import new_path, qualified, spread, staged, write_bytes

TOKENIZERS = "/opt/tokenizers"
#: Tokenizers that cut texts into words by one pattern and merge bytes within words.
BYTE_LEVEL = ["byte_bpe_50k", "byte_bpe_multi_50k"]

# Fixed value: the byte-level tokenizers' pattern; (?U) makes \s any Unicode white space, as there.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN = WORDS[4:]


@cache
def byte_encoding(folder: str, name: str):
    """The tokenizer ``name``, without special tokens."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def text_encoder(folder: str, name: str):
    """A function from a list of texts to lists of ids, for any tokenizer of the folder."""
    if name in BYTE_LEVEL:
        encoding = byte_encoding(folder, name)
        return lambda texts: [encoding.encode_ordinary(t) for t in texts]
    if os.path.exists(path := os.path.join(folder, f"{name}.json")):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))
    return lambda texts: pieces.encode(texts, num_threads=1)


def words_of(text: Column) -> Column:
    """The words into which a byte-level tokenizer cuts a text."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def known_characters(text: Column) -> Column:
    """Whether the JVM knows every character of a text."""
    return ~text.rlike(r"\p{Cn}")


def frequent_words(texts: DataFrame, most: int) -> list[str]:
    """The corpus's words of the highest counts, as many of whole counts as ``most`` allows; counted over all texts."""
    counts = staged(texts.where("text is not null").select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "word_counts")
    # How many words have at least a count: one row for each power of a small base, so never many rows.
    level = F.floor(F.log(1.05, "n") + 1e-9)
    steps = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    total, least = 0, None
    for step, words in steps:
        if total + words > most:
            break
        total, least = total + words, step
    if least is None:
        return []
    return [r["word"] for r in counts.withColumn("level", level).where(F.col("level") >= least).select("word").collect()]


def build_lexicon(spark: SparkSession, words: list[str], folder: str, name: str) -> str:
    """Compile the words and put the file where every worker can map it; returns its location."""
    encoding = byte_encoding(folder, name)
    encoded = sorted({w.encode() for w in words})
    arrays = compile_words(encoded, [list(encoding._core_bpe.encode_single_piece(w)) for w in encoded])
    # A folder without a scheme is on the cluster's own file system, which need not be a local one.
    path = qualified(spark, f"{new_path(spark, 'lexicon')}.bin")
    write_bytes(spark, path, packed(arrays))
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    # A shared folder that cannot be mapped: Spark's own file server brings the file to each executor.
    spark.sparkContext.addFile(path)
    return f"spark-file:{path.rsplit('/', 1)[-1]}"


def _cut(word_lists: pa.ListArray, lexicon: Lexicon, encoding, merged: dict[bytes, list[int]]) -> pa.ListArray:
    """Ids of texts given as lists of words; null for null."""
    bounds = word_lists.offsets.to_numpy()
    coded = word_lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    ranks = lexicon.ranks(distinct)
    n_known = len(lexicon.ids)
    start = np.where(ranks >= 0, lexicon.offset[np.maximum(ranks, 0)] if len(lexicon.offset) else 0, 0)
    length = np.where(ranks >= 0, (lexicon.offset[np.maximum(ranks, 0) + 1] if len(lexicon.offset) > 1 else 0) - start, 0)
    new: list[int] = []
    for k in np.flatnonzero(ranks < 0).tolist():
        ids = merged.get(distinct[k])
        if ids is None:
            if len(merged) >= 200_000:
                merged.clear()
            ids = merged[distinct[k]] = encoding._core_bpe.encode_single_piece(distinct[k])
        start[k], length[k] = n_known + len(new), len(ids)
        new.extend(ids)
    pool = np.r_[lexicon.ids, np.array(new, np.int32)]
    code = coded.indices.to_numpy()
    lengths = length[code]
    ends = np.cumsum(lengths)
    take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[code] - (ends - lengths), lengths)
    offsets = np.r_[0, ends][bounds - bounds[0]].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(pool[take].astype(np.int32)), mask=word_lists.is_null())


def _encode_words(location: str, folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(location.removeprefix("spark-file:")) if location.startswith("spark-file:") else location
        lexicon, encoding, merged = Lexicon(path), byte_encoding(folder, name), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = _cut(pa.concat_arrays([part.column(1)]), lexicon, encoding, merged)
                strange = part.column(2).to_pylist()
                if any(t is not None for t in strange):
                    ids = pa.array([own if t is None else encoding.encode_ordinary(t) for own, t in zip(ids.to_pylist(), strange)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["id", "ids"])

    return run


def _encode_texts(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(folder, name)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                done = iter(encode([t for t in texts if t]))
                ids = [None if t is None else list(next(done)) if t else [] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return run


def encode(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, lexicon_words: int = 65_536) -> DataFrame:
    """(id, ids): the token ids of each row's text, without special tokens; strings of special tokens are ordinary text.

    An empty text gives an empty list and a null text null. Every row gives a row: repeated rows
    and null ids stay. Other columns are ignored. An empty table gives an empty result.
    """
    texts = spread(df.select(df[id_col].alias("id"), df[text_col].alias("text")))
    schema = f"id {texts.schema[0].dataType.simpleString()}, ids array<int>"
    if tokenizer not in BYTE_LEVEL:
        return texts.mapInArrow(_encode_texts(folder, tokenizer), schema)
    location = build_lexicon(df.sparkSession, frequent_words(texts, lexicon_words), folder, tokenizer)
    known = known_characters(F.col("text"))
    cut = texts.select("id", F.when(F.col("text").isNull(), F.lit(None)).when(known, words_of(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("words"), F.when(~known, F.col("text")).alias("strange"))
    return cut.mapInArrow(_encode_words(location, folder, tokenizer), schema)


def _decode(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_encoding(folder, name)
        for batch in batches:
            texts = [None if ids is None else encoding.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, text): the inverse of :func:`encode` for the byte-level tokenizers."""
    if tokenizer not in BYTE_LEVEL:
        raise ValueError(f"{tokenizer} has no exact inverse")
    return encoded.select("id", "ids").mapInArrow(_decode(folder, tokenizer), f"id {encoded.schema['id'].dataType.simpleString()}, text string")

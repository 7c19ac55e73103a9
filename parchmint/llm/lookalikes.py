"""One consistent form for texts that look the same but are written with different characters.

Two steps. *Clean*: widths, spaces, hyphens, ligatures, letter-like signs, invisible characters
and the composition of accents get one form, whatever the text. *Repair*: a token's dominant script is
that of its letters that are drawn like no other script's; its other letters are replaced by
those of that script, provided the result is a token of the corpus. A token of look-alikes alone
has no script of its own and takes that of its text, decided by the same letters of all its tokens.

Two texts that look the same have the same deciding letters, so they get the same scripts; and where
their tokens differ, the one result is a token of the corpus, or at least two tokens lead to it,
which counts as well. So texts that look the same get one form, and comparing forms finds them.

Clean works on one text alone. A repair moves only the texts that have such tokens; the vocabulary is
looked up for the distinct results that repairs would give, not built as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.staging import is_small, spread, staged

# Letters of Cyrillic and Greek with the Latin letter drawn like them.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
}
# Capitals of Greek with the Cyrillic letter drawn like them, where Latin has none.
GREEK_CYRILLIC = {"Γ": "Г", "Π": "П", "Φ": "Ф"}

# Characters without width or ink (joiners are treated apart), and hyphens of one shape.
INVISIBLE = "­͏؜᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
HYPHENS = "‐‑"
#: Signs that are drawn as letters and have no canonical equivalent: micro, degrees Celsius and Fahrenheit, Hebrew letters as signs.
SIGNS = "µ℃℉ℵℶℷℸ"

_EMOJI = "©®‼-㊙\U0001f000-\U0001faff"
_JOINS = "؀-෿"  # scripts in which a joiner changes the shape of letters
JOINER = re.compile(f"(?<![{_EMOJI}️{_JOINS}])[‌‍]|[‌‍](?![{_EMOJI}{_JOINS}])")
SELECTOR = re.compile(f"(?<![{_EMOJI}])[︀-️]")
# A token: letters with their accents, for Python and for the JVM.
LETTERS = r"(?:\p{L}\p{M}*)+"
TOKEN = regex.compile(LETTERS)
OTHER_SCRIPT = re.compile("[Ͱ-Ͽἀ-῿Ѐ-ԯ]")
SCRIPTS = "LGC"


@cache
def clean_table() -> dict[int, str]:
    """What single characters become: from Unicode's own decompositions, by rule."""
    table: dict[int, str] = {}
    for code in range(0x80, 0x30000):
        char = chr(code)
        how = unicodedata.decomposition(char)
        name = unicodedata.name(char, "")
        wide = how.startswith(("<wide>", "<narrow>"))
        ligature = how.startswith("<compat>") and ("LIGATURE" in name or 0x01C4 <= code <= 0x01CC or 0x01F1 <= code <= 0x01F3) and not 0xFB50 <= code <= 0xFEFC
        numeral = how.startswith("<compat>") and 0x2160 <= code <= 0x217F
        if unicodedata.category(char) == "Zs":
            table[code] = " "
        elif wide or ligature or numeral or char in SIGNS:
            table[code] = unicodedata.normalize("NFKC", char)
    table |= {ord(c): "" for c in INVISIBLE} | {ord(c): "-" for c in HYPHENS}
    return table


@cache
def changing():
    """Finds the characters that :func:`clean_table` changes, joiners and selectors."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(clean_table())) + "\u200c\u200d\ufe00-\ufe0f]")


@cache
def drawn_alike() -> dict[str, dict[str, str]]:
    """For each letter that is drawn like one of another script: its counterpart in each script, itself included."""
    groups: dict[str, dict[str, str]] = {}
    for latin in [*GREEK.values(), *CYRILLIC.values()]:
        groups[latin] = {"L": latin}
    for script_of, letters in (("G", GREEK), ("C", CYRILLIC)):
        for own, latin in letters.items():
            groups[latin].setdefault(script_of, own)
            groups[own] = groups[latin]
    for greek, cyrillic in GREEK_CYRILLIC.items():
        groups[greek] = groups[cyrillic] = {"G": greek, "C": cyrillic}
    return groups


def script(char: str) -> str:
    """L, C or G for a Latin, Cyrillic or Greek letter, else nothing."""
    code = ord(char)
    if code < 0x250 or 0x1E00 <= code <= 0x1EFF:
        return "L"
    if 0x370 <= code <= 0x3FF or 0x1F00 <= code <= 0x1FFF:
        return "G"
    return "C" if 0x400 <= code <= 0x52F else ""


def clean(text: str) -> str:
    """The text with widths, spaces, hyphens, ligatures, signs, invisible characters and accents in one form."""
    if text.isascii() or not changing().search(text):
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    table = clean_table()
    text = JOINER.sub("", text)
    text = changing().sub(lambda m: table.get(ord(m.group()), m.group()), text)
    return SELECTOR.sub("", unicodedata.normalize("NFC", text))


def deciding(token: str) -> tuple[int, int, int]:
    """How many letters of a cleaned token only Latin, only Greek and only Cyrillic has."""
    alike = drawn_alike()
    n = Counter(script(c) for c in unicodedata.normalize("NFD", token) if c not in alike and unicodedata.category(c)[0] == "L")
    return n["L"], n["G"], n["C"]


def dominant(counts: tuple[int, int, int]) -> str:
    """The script of most deciding letters, the first of Latin, Greek and Cyrillic if several; nothing without any."""
    return SCRIPTS[counts.index(max(counts))] if any(counts) else ""


def repair(token: str, of_text: str = "L") -> str | None:
    """A cleaned token in its dominant script, or that of its text if it is of look-alikes alone; null if it is so already.

    A look-alike that the script does not have is written in the first of Latin, Greek and Cyrillic that has it.
    """
    own, alike = dominant(deciding(token)) or of_text, drawn_alike()
    parts = []
    for c in unicodedata.normalize("NFD", token):
        group = alike.get(c)
        parts.append(c if group is None else group.get(own) or next(iter(group.values())))
    done = unicodedata.normalize("NFC", "".join(parts))
    return None if done == token else done


class Repairs:
    """Scripts and repairs of tokens, kept as they come; emptied when they are ``limit``."""

    def __init__(self, limit: int = 100_000):
        self.limit = limit
        self.counts: dict[str, tuple[int, int, int]] = {}
        self.results: dict[tuple[str, str], str | None] = {}

    def wished(self, text: str) -> dict[str, str]:
        """The tokens of a cleaned text that a repair would change, with the result."""
        tokens = TOKEN.findall(text)
        total = [0, 0, 0]
        for t in tokens:
            if (n := self.counts.get(t)) is None:
                if len(self.counts) >= self.limit:
                    self.counts.clear()
                n = self.counts[t] = deciding(t)
            total[0] += n[0]
            total[1] += n[1]
            total[2] += n[2]
        own = dominant(tuple(total)) or "L"
        found = {}
        for t in set(tokens):
            if (t, own) not in self.results:
                if len(self.results) >= self.limit:
                    self.results.clear()
                self.results[t, own] = repair(t, own)
            if better := self.results[t, own]:
                found[t] = better
        return found


def _clean_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Repairs()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            keys, texts, wishes = [], [], []
            for text in part.column(1).to_pylist():
                if text is None:
                    keys.append(None), texts.append(None), wishes.append(None)
                    continue
                keys.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63)
                texts.append(tidy := clean(text))
                found = own.wished(tidy) if not tidy.isascii() and OTHER_SCRIPT.search(tidy) else None
                wishes.append(list(found.items()) if found else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(wishes, pa.map_(pa.string(), pa.string()))], ["id", "raw", "text", "wishes"])


def _apply_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, repairs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            accepted = dict((r["token"], r["better"]) for r in repairs)
            text = TOKEN.sub(lambda m: accepted.get(m.group(), m.group()), text)
            texts.append(unicodedata.normalize("NFC", text))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "raw", "text"])


def normalised(df: DataFrame, id_col: str, text_col: str, broadcast_rows: int = 500_000) -> DataFrame:
    """(id, raw, text): each row's text in its consistent form; ``raw`` is a hash of the text as it was.

    Null stays null, an empty text empty; a text of invisible characters alone becomes empty. Exactly
    repeated rows with a token to repair count once, and stay elsewhere; an id with several
    texts keeps each. Rows with a null id stay, unrepaired. Other columns are ignored.
    """
    texts = spread(df.select(df[id_col].alias("id"), df[text_col].alias("text")))
    id_type = texts.schema[0].dataType.simpleString()
    tidy = staged(texts.mapInArrow(_clean_batches, f"id {id_type}, raw bigint, text string, wishes map<string,string>"), "tidy")
    wishing = F.col("wishes").isNotNull() & F.col("id").isNotNull()
    wishes = tidy.where(wishing).select("id", "raw", F.explode("wishes").alias("token", "better"))
    results = staged(wishes.groupBy("better").agg((F.min("token") != F.max("token")).alias("several")), "results")
    small = is_small(results, broadcast_rows)
    sought = results.where("not several").select("better")
    tokens = tidy.where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("better"))
    vocabulary = tokens.join(F.broadcast(sought) if small else sought, "better", "left_semi").distinct().unionByName(results.where("several").select("better"))
    accepted = wishes.join(F.broadcast(vocabulary) if small else vocabulary, "better").groupBy("id", "raw").agg(F.collect_set(F.struct("token", "better")).alias("repairs"))
    held = tidy.where(wishing).dropDuplicates(["id", "raw"]).join(accepted, ["id", "raw"], "left").select("id", "raw", "text", F.coalesce("repairs", F.array().cast("array<struct<token:string,better:string>>")).alias("repairs"))
    repaired = held.mapInArrow(_apply_batches, f"id {id_type}, raw bigint, text string")
    return tidy.where(~wishing).select("id", "raw", "text").unionByName(repaired)


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["id", "raw", "k1", "k2"])


def look_alikes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts differ as strings but have one consistent form.

    Null texts and null ids are in no pair; an empty text looks like one of invisible characters.
    Repeated rows count once, and exact copies are no pair of each other. Copies are classes (form and
    text), classes are paired, and only then their rows.
    """
    tidy = normalised(df, id_col, text_col).where("id is not null and text is not null")
    keys = staged(tidy.mapInArrow(_hash_batches, f"id {tidy.schema[0].dataType.simpleString()}, raw bigint, k1 bigint, k2 bigint"), "looks")
    several = keys.groupBy("k1", "k2").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("k1", "k2")
    held = staged(keys.join(several, ["k1", "k2"], "left_semi").distinct(), "alike")
    classes = held.select("k1", "k2", "raw").distinct()
    met = classes.withColumnRenamed("raw", "raw_x").join(classes.withColumnRenamed("raw", "raw_y"), ["k1", "k2"]).where("raw_x < raw_y")
    left, right = held.withColumnsRenamed({"id": "x", "raw": "raw_x"}), held.withColumnsRenamed({"id": "y", "raw": "raw_y"})
    pairs = met.join(left, ["k1", "k2", "raw_x"]).join(right, ["k1", "k2", "raw_y"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

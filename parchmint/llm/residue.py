"""Captures that hold unfilled fields, filler or error messages instead of content.

Records made from one template are aligned by their sentences: capitalised words, numbers and host
names are slots, the other words are the template. From the corpus, not from a list, come

* the *slots*: places that many records of one template fill differently. A plain word that stands in such a
  place again and again, as the one plain word that does, is a program's default and no value.
* the *whole-page templates*: sentences that many captures fill differently and that stand almost alone
  in their captures. A capture all of whose content sentences are such is no content, however long it is.

A variable's name is told by its notation (braces, brackets, percent signs and so on), a blank by the
comma that follows nothing; these are judged in their own sentence, so that other rows change nothing: one
written as a field is residue unless the sentence speaks about fields or says that something reads so, a
program's empty value where its clause has nothing else to fill. Code, inline code and quotations are
content and are not looked at. A few general seeds let a small table without repetitions be judged alike.

At scale: two passes over the texts yield hashes, the second only those that fill induced slots. Alignment
is aggregation over hashes with partial sums; templates are sent to all tasks only if they are few.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.main_content import LineClassifier
from parchmint.llm.shingles import WORD
from parchmint.staging import is_small, spread, staged

# How template languages and mail tools write a field.
FIELDS = [
    r"\{\{[^{}\n]*\}\}", r"\$\{[^{}\n]+\}", r"#\{[^{}\n]+\}", r"\{%[^%\n]*%\}", r"<%[^%\n]*%>", r"\*\|[^|\n]+\|\*", r"%%[A-Za-z_.]+%%", r"(?<![\w%])%[A-Z][A-Z_]{2,}%", r"@@\w+@@", r"~~\w+~~",
    r"\[\[[^\[\]\n]+\]\](?!\()", r"(?<![\w_])__[A-Za-z][A-Za-z_]*?__(?![\w_])", r"(?<![{$#\w])\{[A-Za-z][\w .|]*\}(?!\})", r"<[A-Z][A-Z ]+>", r"\[(?:[A-Z]{2,}[A-Z ]*|(?i:(?:first|last|full|your|insert|add|enter|working|article|page|company)\b[^\[\]\n]*|[^\[\]\n]*\b(?:here|title|name)))\](?!\()",
    r"(?<![{$#\w])\{(?:\d+|\$[\w.]+)\}(?!\})", r"\(?\b(?:TODO|FIXME)\b:?[^()\n]*\)?", r"\[object \w+\]",
]
# What a program writes for an empty value, words in brackets (but for marks of editors and captions), and greetings without a name.
EMPTY = [r"(?<![!\]\w])\[(?!(?i:sic|music|applause|laughter|citation needed|note|edit)\b)[A-Za-z][a-z]+(?: [A-Za-z]+){0,3}\](?![(\[])", r"\bundefined\b", r"\bnull\b", r"\bNaN\b", r"\bInvalid Date\b", r"(?<!\w)None(?= (?:items|readers))", r"^(?:Dear|Hello|Hi|Hallo|Bonjour|Hola|Guten Tag)\s*,"]
FIELD = re.compile("|".join(FIELDS))
BARE = re.compile("|".join(EMPTY))
HINT = re.compile(r"\{[{%A-Za-z\d$]|[$#]\{|<[%A-Z]|\*\||%%|%[A-Z]|@@|~~|\[\[|__[A-Za-z]|\[[^\[\]\n]+\](?!\()|TODO|FIXME|\[object|undefined|null|NaN|Invalid Date|None|\b(?:Dear|Hello|Hi|Hallo|Bonjour|Hola|Guten Tag)\s*,")

# A title that a form suggests.
DEFAULT_TITLE = re.compile(r"(?i)^\W*(?:insert|enter|add|type|replace)\b.{0,40}\b(?:here|headline|title|text)\W*$")

# Words by which a sentence speaks about fields.
ABOUT = re.compile(r"\b(?:fields?|templates?|placeholders?|braces?|syntax|variables?|Feld(?:er)?|Platzhalter|Vorlagen?|Klammern|champs?|gabarits?|accolades|campos?|plantillas?|llaves|marcadores?)\b", re.I)

# What, by a sentence, reads as the field after it.
READS = re.compile(r"\b(?:sheet|form|letter|page|sign|label|note|line|screen|mail|e-?mail|message|header|heading|title|card) (?:said|says|reads?|showed|shows) (?=⟦)|\b(?:Blatt|Formular|Brief|Seite|Schild|Zeile|Bildschirm) (?:zeigte?|lautete?) (?=⟦)|\b(?:feuille|formulaire|lettre|page|ligne|écran) (?:disait|affichait|indiquait|affiche|indique) (?=⟦)|\b(?:hoja|formulario|carta|página|línea|pantalla) (?:decía|mostraba|dice|muestra) (?=⟦)", re.I)

# A few seeds of messages that stand for a page, by words that most of them share.
SEEDS = re.compile(
    r"(?i)\bpage not found\b|\bnot found$|\berror [45]\d\d\b|\b[45]\d\d (?:error|not found|forbidden|bad gateway|service unavailable)|\baccess ?denied\b|\bcaptcha\b|\bnot a robot\b|\bverify (?:that )?you are human\b"
    r"|\b(?:enable|activate|allow|aktivier\w*|activer|activez|active|habilit\w*) (?:sie )?(?:javascript|scripts?)\b|\bjavascript (?:is )?(?:disabled|required)\b|\blorem ipsum dolor\b|\b(?:sample|placeholder) text\b|\breplace this (?:text|paragraph)\b"
)
# Every seed holds one of these, in lower case; every hint at a field one of those.
SEED_PARTS = ("not found", "error ", " error", "forbidden", "bad gateway", "unavailable", "denied", "captcha", "robot", "human", " javascript", " script", "javascript ", "lorem ipsum", "sample text", "placeholder text", "replace this")
HINT_PARTS = ("{", "<", "*|", "%", "@@", "~~", "__", "TODO", "FIXME", "undefined", "null", "NaN", "Invalid Date", "None", "Dear", "Hello", "Hi ", "Hi,", "Hi\n", "Hallo", "Bonjour", "Hola", "Guten Tag")
# Words of the usual filler Latin.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())

FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
QUOTED = re.compile(r"`[^`\n]*`|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»")
STRAIGHT = re.compile(r"\"[^\"\n]*\"")
SENTENCE = re.compile(r"(?<=[.!?…])\s+")
HOST = re.compile(r"\b[\w\-]+(?:\.[\w\-]+)+\b|https?://\S+")
DOTTED = re.compile(r"\.\w|://")
STEM = re.compile(r"[^\W_]+|⟦[^⟧]*⟧|\n|[.!?…](?=\s)")



def prose(text: str) -> str:
    """The text without code, quotations and quoted lines."""
    if "```" in text or "~~~" in text:
        text = FENCE.sub("", text)
    if "`" in text or "“" in text or "«" in text or "„" in text:
        text = QUOTED.sub("", text)
    if '"' in text:
        text = "\n".join(x if x.lstrip()[:1] in "{[<" else STRAIGHT.sub("", x) for x in text.split("\n"))
    return text


def _plain(clause: str) -> bool:
    """Whether nothing but the field is to be filled in a clause: its one capital may only begin it."""
    slots = [w for w in STEM.findall(HOST.sub("H1", clause)) if not (w[0] == "⟦" or w.islower() and w.isalpha() or w in ".!?…\n")]
    return not slots or len(slots) == 1 and clause.lstrip(" ([*").startswith(slots[0]) and not slots[0].isdigit()


def fields_of(text: str) -> list[dict]:
    """The sentences with a field: whether the field is marked, whether its clause is plain.

    A field is marked if it is written as one, not merely as an empty value. Sentences that speak
    about fields, or say that something reads so, are left out.
    """
    found = []
    if not HINT.search(text):
        return found
    for line in text.split("\n"):
        if not HINT.search(line) or line.lstrip()[:1] == ">" and line.lstrip()[:3] not in ("> —", "> –"):
            continue
        for sentence in SENTENCE.split(line.strip()):
            if not HINT.search(sentence) or ABOUT.search(FIELD.sub("", sentence)):
                continue
            filled = FIELD.sub(lambda m: f"⟦{m.group()}⟧", sentence)
            marked = "⟦" in filled
            if not marked:
                filled = BARE.sub(lambda m: f"⟦{m.group()}⟧", sentence)
            if "⟦" not in filled:
                continue
            if READS.search(filled):
                continue
            plain = any(_plain(c) for c in re.split(r"[,;:–—|]\s", filled) if "⟦" in c)
            found.append({"marked": marked, "plain": plain})
    return found


def default_title(title: str) -> bool:
    """Whether a title is a form's suggestion or filler Latin."""
    w = WORD.findall(title.lower())
    return bool(DEFAULT_TITLE.match(title)) or len(w) > 1 and all(x in LATIN for x in w)


class Parts(dict):
    """Codes of the parts of texts, kept as they come, and by code: the hash of what a template keeps of the part, its own hash,
    its kind (0 word, 1 slot, 2 end of a sentence, 3 end of a line), and whether it is filler Latin."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit, self.rows = limit, []
        self.table = np.empty((0, 4), np.uint64)

    def __missing__(self, part: str) -> int:
        own = xxhash.xxh3_64_intdigest(part)
        kind = 3 if part == "\n" else 2 if part in ".!?…" else 0 if part[0] == "⟦" or part.islower() and part.isalpha() else 1
        self.rows.append((SLOT if kind == 1 else own, own, kind, part.lower() in LATIN))
        code = self[part] = len(self.rows) - 1
        return code

    def of(self, parts: list[str]) -> np.ndarray:
        """Rows of the table for parts."""
        if len(self) > self.limit:
            self.clear()
            self.rows, self.table = [], np.empty((0, 4), np.uint64)
        codes = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.uint64)])
        return self.table[codes]


SLOT = 0x9E3779B97F4A7C15
_parts = Parts()
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd number, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, 0xD1342543DE82EF95, np.uint64)], dtype=np.uint64)
    return _powers[:n]


class Sentences:
    """Sentences, by number: ``templates`` (hashes of words and slots, adjacent slots as one), their ``halves``, ``fillings`` (of the slots),
    how many ``plain`` words and ``slots`` each has, and whether most of its words are filler ``latin``.

    All sentences of the lines of a slice of the table are taken at once; ``line`` is the number of each one's line.
    """

    def __init__(self, lines: list[str]):
        self.parts = STEM.findall("\n".join(HOST.sub("H1", x) if DOTTED.search(x) else x for x in lines))
        if not self.parts:
            self.templates = self.fillings = self.plain = self.slots = np.empty(0, np.uint64)
            self.latin, self.line, self.halves = np.empty(0, bool), np.empty(0, np.int64), (self.templates, self.templates)
            return
        table = _parts.of(self.parts)
        kind = np.minimum(table[:, 2], np.uint64(2))
        starts = np.flatnonzero(np.r_[True, (kind[:-1] == 2) & (kind[1:] != 2)])
        of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(kind)]))
        slot = kind == 1
        kept = (kind == 0) | slot & ~np.r_[False, slot[:-1]]  # a run of slots is one
        counted = np.cumsum(kept) - kept
        place = counted - counted[starts][of]
        at = np.arange(len(kind)) - starts[of]
        power = powers(int(at.max()) + 2)
        self.weight = power[place]
        add = lambda x: np.add.reduceat(x, starts)
        hashed = np.where(kept, table[:, 0] * self.weight, np.uint64(0))
        self.templates = add(hashed)
        # A sentence that differs in one word has one half, and the length, of the template.
        n = add(kept.astype(np.int64))
        first = add(np.where(2 * place < n[of], hashed, np.uint64(0)))
        size = n.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        self.halves = (first ^ size, (self.templates - first) ^ size ^ np.uint64(1))
        self.fillings = add(np.where(slot, table[:, 1] * power[at], np.uint64(0)))
        self.plain, self.slots = add((kind == 0).astype(np.int64)), add((kept & slot).astype(np.int64))
        words = add((kind != 2).astype(np.int64))
        self.latin = (words >= 4) & (add(table[:, 3].astype(np.int64)) >= 0.7 * words)
        self.line = np.cumsum(table[:, 2] == 3)[starts] - (table[starts, 2] == 3)
        self.table, self.kind, self.of = table, kind, of

    def masked(self, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(sentence, template, word) for each plain word in whose place ``known`` templates (sorted; null: any) have a slot."""
        if not self.parts or known is not None and not len(known):
            return np.empty(0, np.int64), np.empty(0, np.int64), []
        slot = self.kind == 1
        near = np.r_[False, slot[:-1]] | np.r_[slot[1:], False]
        at = np.flatnonzero((self.kind == 0) & ~near & (self.plain[self.of] >= 4))
        made = self.templates[self.of[at]] + (np.uint64(SLOT) - self.table[at, 0]) * self.weight[at]
        if known is not None:
            hit = known[np.minimum(np.searchsorted(known, made), len(known) - 1)] == made
            at, made = at[hit], made[hit]
        return self.of[at], made.view(np.int64), [self.parts[k] for k in at.tolist()]


def _blanked(text: str) -> str:
    """The prose of a text, with code blanked in place, so that lines keep their numbers."""
    if "```" in text or "~~~" in text:
        text = FENCE.sub(lambda m: "\n" * m.group().count("\n"), text)
    return prose(text)


#: What is left off the ends of a line.
LEAD, TAIL = " \t\r>*_-#\u00a0", " \t\r*_"


def content_of(text: str, title: str | None, gone: set[int]) -> list[tuple[str, bool, int]]:
    """(line, whether content, which of its sentences seeds name, as bits) of a page's prose: content is no furniture, no heading, not the title again.

    A page of which nothing else is left has its headings and furniture as content.
    """
    low = text.lower()
    name, hinted = (title or "").strip().lower(), any(x in low for x in SEED_PARTS)
    out, some = [], False
    for k, raw in enumerate(_blanked(text).split("\n"), 1):
        if line := raw.lstrip(LEAD).rstrip(TAIL):
            own = k not in gone and raw.lstrip()[:1] != "#" and (len(line) != len(name) or line.lower() != name)
            seeds = 0
            if hinted and SEEDS.search(line):
                pieces = [x for x in SENTENCE.split(line) if WORD.search(x)]
                seeds = sum(1 << j for j, x in enumerate(pieces) if SEEDS.search(x)) or (1 << len(pieces)) - 1
            some = some or own
            out.append((line, own, seeds))
    return out if some else [(line, True, seeds) for line, _, seeds in out]


#: A row a sentence, or one without a sentence for a capture that has none. ``fresh`` marks the first content sentence of a template
#: in its capture, ``n`` is how many different content sentences the capture has.
SCHEMA = "version bigint, field boolean, h bigint, slots bigint, content boolean, seeded boolean, open boolean, fresh boolean, a bigint, b bigint, n int"


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Which rows are the first of their keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.zeros(len(order), bool)
    first[order[new]] = True  # the sort is stable
    return first


def _parse(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: LineClassifier = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                titles, texts = part.column(1).to_pylist(), [t or "" for t in part.column(2).to_pylist()]
                field, held, lines = np.zeros(len(texts), bool), [], np.zeros(len(texts), np.int64)
                for k, (title, text, gone) in enumerate(zip(titles, texts, own.furniture_of(texts))):
                    found = fields_of(prose(text)) if text.count("[") != text.count("](") or any(x in text for x in HINT_PARTS) else []
                    found = found + fields_of(prose(title)) if title else found
                    field[k] = any(f["marked"] or f["plain"] for f in found) or bool(title) and default_title(title)
                    held += (own_lines := content_of(text, title, set(gone)))
                    lines[k] = len(own_lines)
                s = Sentences([x for x, _, _ in held])
                content = np.array([own for _, own, _ in held], bool)[s.line]
                named = np.zeros(len(content), bool)
                first = np.searchsorted(s.line, np.arange(len(held) + 1))
                for k, seeds in ((k, x[2]) for k, x in enumerate(held) if x[2]):
                    named[first[k] : first[k + 1]] = [bool(seeds >> j & 1) for j in range(first[k + 1] - first[k])]
                seeded = content & (named | s.latin)
                kept = np.flatnonzero((s.plain > 0) | seeded)  # slots alone say nothing
                of = np.repeat(np.arange(len(texts)), lines)[s.line[kept]]
                h, slots, content = s.templates[kept], s.fillings[kept], content[kept]
                fresh, different = np.zeros(len(kept), bool), np.zeros(len(kept), bool)
                told = np.flatnonzero(content)
                fresh[told] = _firsts(h[told], of[told])
                different[told] = _firsts(slots[told], h[told], of[told])
                n = np.bincount(of, different, len(texts)).astype(np.int32)
                # One row a sentence, and one for each capture without any.
                row = np.sort(np.r_[of, np.setdiff1d(np.arange(len(texts)), of)])
                has = np.isin(row, of)
                place = pa.array(np.where(has, np.cumsum(has) - 1, 0), mask=~has)
                versions = np.array([xxhash.xxh3_64_intdigest(f"{title}\n{text}".encode("utf-8", "surrogatepass")) for title, text in zip(titles, texts)], np.uint64).view(np.int64)
                of_sentence = [h.view(np.int64), slots.view(np.int64), content, seeded[kept], ((s.slots > 0) & (s.plain >= 3))[kept], fresh, *(x[kept].view(np.int64) for x in s.halves)]
                columns = [pa.array(x).take(place) for x in of_sentence]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(versions[row]), pa.array(field[row]), *columns, pa.array(n[row])],
                    ["id", "version", "field", "h", "slots", "content", "seeded", "open", "fresh", "a", "b", "n"],
                )

    return run


def _fill(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = None if known is None else known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                held = [[x for raw in _blanked(text).split("\n") if (x := raw.lstrip(LEAD).rstrip(TAIL))] for text in part.column(1).to_pylist()]
                rows = np.repeat(np.arange(len(held)), [len(x) for x in held])
                s = Sentences([x for lines in held for x in lines])
                sentence, hashes, words = s.masked(templates)
                at = rows[s.line[sentence]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(hashes), pa.array(words, pa.string())], ["id", "h", "word"])

    return run


#: Up to so many templates are sent to all tasks, 8 bytes each.
SMALL_TEMPLATES = 500_000


def defaults(rows: DataFrame, parsed: DataFrame, min_filled: int = 20, min_records: int = 3, share: float = 0.9) -> DataFrame:
    """(id, h, word): captures where a plain word stands in an induced slot as a program's default.

    A slot is induced where one template is filled at least ``min_filled`` times, half of them differently. A word is
    a default if at least ``min_records`` captures have it there and of the plain words that stand
    there it is all but ``1 - share``: where an author may write a plain word, there are several.
    """
    filled = parsed.where("open").groupBy("h", "slots").agg(F.count("*").alias("n"))
    slots = filled.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("fillings")).where((F.col("n") >= min_filled) & (F.col("fillings") * 2 >= F.col("n")))
    slots = staged(slots.select("h"), "slot_templates")
    halved = parsed.where("open").select("h", "a", "b").join(F.broadcast(slots) if is_small(slots, SMALL_TEMPLATES) else slots, "h", "left_semi")
    slots = halved.groupBy("h").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    slots = staged(slots.select("h", "a", "b"), "slots")
    small = is_small(slots, SMALL_TEMPLATES)
    near = lambda df: F.broadcast(df) if small else df
    # Only captures with half a template, but not the template, are read again.
    halves = slots.select(F.explode(F.array("a", "b")).alias("half")).distinct()
    some = parsed.where("h is not null").select("id", "h", F.explode(F.array("a", "b")).alias("half")).join(near(halves), "half", "left_semi").join(near(slots.select("h")), "h", "left_anti")
    some = staged(some.select("id").distinct(), "half_templates")
    again = rows.where("text is not null").select("id", "text").join(F.broadcast(some) if is_small(some, SMALL_TEMPLATES) else some, "id", "left_semi")
    known = rows.sparkSession.sparkContext.broadcast(np.sort(np.array([r["h"] for r in slots.select("h").collect()], np.int64).view(np.uint64))) if small else None  # at most SMALL_TEMPLATES
    found = again.mapInArrow(_fill(known), f"id {rows.schema['id'].dataType.simpleString()}, h bigint, word string")
    found = staged((found if small else found.join(slots, "h", "left_semi")).distinct(), "plain_fillings")
    words = found.groupBy("h", "word").agg(F.count("*").alias("n"))
    best = words.groupBy("h").agg(F.max_by("word", F.struct("n", "word")).alias("word"), F.max("n").alias("n"), F.sum("n").alias("all"))
    best = best.where((F.col("n") >= min_records) & (F.col("n") >= share * F.col("all")))
    return found.join(best.select("h", "word"), ["h", "word"], "left_semi")


def residue(df: DataFrame, id_col: str, title_col: str, text_col: str, min_records: int = 3, alone: float = 0.25, share: float = 0.9, model: LineClassifier | None = None) -> DataFrame:
    """(id, why): captures without real content; ``why`` is "field" or "page", "field" first.

    A page template needs ``min_records`` different pages (title, furniture and all) and must be at least ``alone`` of
    the different content sentences (fillings included) in at least ``share`` of its captures. A capture whose content sentences all are page
    templates or seeded is a case, whatever its length; sentences that are furniture in most of their captures
    are so here. Rows with a null id are left out; a null
    title or text is an empty one, and an empty page is no case. Rows that repeat an id count once,
    and an id is a case if any of its texts is. Other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = spread(df.select(df[id_col].alias("id"), df[title_col].alias("title"), df[text_col].alias("text")).where("id is not null"))
    shared = spark.sparkContext.broadcast(model or LineClassifier.train())
    parsed = staged(rows.mapInArrow(_parse(shared), f"id {rows.schema[0].dataType.simpleString()}, {SCHEMA}"), "parsed")

    unfilled = parsed.where("field").select("id", F.lit("field").alias("why"))
    unfilled = unfilled.unionByName(defaults(rows, parsed).select("id", F.lit("field").alias("why")))

    pages = parsed.where("content")
    lines = pages.where(F.col("fresh") & (F.col("n") * alone <= 1)).select("version", "h").distinct()
    wanted = staged(lines.groupBy("h").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_records).select("h"), "page_templates")
    few = F.broadcast(wanted) if is_small(wanted, SMALL_TEMPLATES) else wanted
    templates = pages.where("fresh").select("n", "h").join(few, "h", "left_semi").groupBy("h").agg(F.avg((F.col("n") * alone <= 1).cast("int")).alias("often")).where(F.col("often") >= share).select("h", F.lit(True).alias("known"))
    templates = staged(templates, "known_templates")
    templates = F.broadcast(templates) if is_small(templates, SMALL_TEMPLATES) else templates
    read = pages.select("id", "version", "h", "seeded").join(templates, "h", "left").select("id", "version", "h", (F.col("seeded") | F.coalesce("known", F.lit(False))).alias("told"))
    some = staged(read.groupBy("id", "version").agg(F.min("told").alias("all"), F.max("told").alias("any")).where("any").select("id", "version", "all"), "told")
    # Pages with some such sentences: the others may be furniture that was taken for content here, and mostly is not elsewhere.
    mixed = some.where(~F.col("all")).select("id", "version")
    mixed = F.broadcast(mixed) if is_small(mixed, SMALL_TEMPLATES) else mixed
    others = staged(read.where(~F.col("told")).join(mixed, ["id", "version"], "left_semi").select("id", "version", "h").distinct(), "others")
    asked = others.select("h").distinct()
    asked = F.broadcast(asked) if is_small(asked, SMALL_TEMPLATES) else asked
    use = parsed.where("h is not null").select("h", "content").join(asked, "h", "left_semi").groupBy("h").agg(F.avg(F.col("content").cast("int")).alias("content"), F.count("*").alias("n"))
    beside = staged(use.where((F.col("n") >= min_records) & (F.col("content") < 0.5)).select("h", F.lit(1).alias("beside")), "beside")
    beside = F.broadcast(beside) if is_small(beside, SMALL_TEMPLATES) else beside
    rest = others.join(beside, "h", "left").groupBy("id", "version").agg(F.count_if(F.col("beside").isNull()).alias("left"))
    broken = some.where("all").select("id").unionByName(rest.where("left = 0").select("id")).select("id", F.lit("page").alias("why"))
    return unfilled.unionByName(broken).groupBy("id").agg(F.min("why").alias("why"))

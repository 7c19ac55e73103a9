"""The main body of a page, without menus, notices, prompts, sidebars and footers.

A page is a flat sequence of text blocks (its lines). Each is described by its word count, link
density, signs and place, by those of its neighbours and of the lines it stands together with, and by how many
of its words are words of page furniture in general (:data:`FURNITURE_WORDS`). Decision trees trained on a
small labelled table (:mod:`parchmint.llm.labelled_blocks`) tell content from furniture by their mean.

Training takes the labelled table only (``pages`` variants of its pages, a documented bound); the corpus
is one pass without a shuffle, each page on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parchmint.llm import labelled_blocks
from parchmint.llm.shingles import WORD
from parchmint.staging import spread

# Beginnings of words that page furniture uses more than prose does, in English, German, French, Spanish and Italian.
FURNITURE_WORDS = """
    accept accessib advert affiliate agb allow author autor byline breadcrumb browser cancel career carrello categor channel choices comment commission communit consent contact cookie copyright copy
    datenschutz deliver disclaim download email faq feed feedback filed follow footer forward free help home impressum imprint inbox jobs join kontakt legal licen like link log login logout
    mail member menu minute mehr newsletter news notice older opinion partner permission podcast policy popular post powered preferen press previous privacy privat prohibit publish read register
    related reply report reprint reproduc reserved rights rss send setting share shop sign sitemap skip social sponsor subscri support tag terms topic topics tracking trend updat written akzept ablehn
    abo abonn angebot anmeld anzeig artikel beitrag beitr cookies einloggen einstell empfehl facebook folgen haftung kommentar leser lesezeit meinung mitglied nachdruck nachricht nutzung postfach
    redaktion registrier schlagw startseite teilen thema themen verwend vorbehalten weiter werbe werbung zustimm abonnez accueil actualit aimer article avis commentaire confidential connexion connect
    contenu droits emploi gratuit lecture mentions partag politique plus précédent presse propos recevez recherch recrutement réseaux réserv soutenez suivant sujet acepta acerca acceder ajuste
    anterior aviso ayud boletin boletín buscar buz compart comentari comercial contenido derechos empleo enlace escrib etiquet gratis inicio lectura mapa más menciones noticias permis política
    privacidad publicidad publicac recib redacc registr reservad rechaz siga siguiente síganos socio soporte suscri temas también volver accetta condividi informativa iscriviti riservati diritti
""".split()
LEAST_STEM = 3

LETTERS = re.compile(r"[^\W\d_]+")
LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
EDGE = " \t>*_-\u00a0"
MARK = re.compile("[0-9|·/→←»«›©@↑✉]")

FEATURES = [
    "words", "link_density", "furniture_words", "furniture_share", "heading", "code", "table", "item", "sentence_end", "separators", "digits", "upper", "links", "sign",
    "words_before", "links_before", "furniture_before", "words_after", "links_after", "furniture_after", "block_lines", "block_words", "block_furniture", "block_links",
    "prose_before", "prose_after", "from_top", "from_bottom", "capitals", "quote", "emphasis",
]


class FurnitureWords(dict):
    """Kinds of words, kept as they come: 1 if one begins like a word of page furniture, and 2 more if it has a capital; emptied when it holds ``limit``."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit, self.stems = limit, frozenset(FURNITURE_WORDS)
        self.longest = max(map(len, FURNITURE_WORDS))

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        low = word.lower()
        kind = self[word] = any(low[:k] in self.stems for k in range(LEAST_STEM, min(len(low), self.longest) + 1)) + 2 * word[0].isupper()
        return kind


_words = FurnitureWords()


def described(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text (from 0), number (from 1) and features of the non-blank lines of pages."""
    page, number, own, blocks, block = [], [], [], [], -1
    for at, text in enumerate(texts):
        fenced, blank = False, True
        for k, raw in enumerate(text.split("\n"), 1):
            line = raw.strip()
            if not line:
                blank = True
                continue
            if blank and not fenced:
                block += 1
            blank = False
            fence = line.startswith(("```", "~~~"))
            code = fenced or fence
            fenced ^= fence
            page.append(at)
            number.append(k)
            blocks.append(block)
            linked = LINK.findall(line) if "](" in line else ()
            shown = LINK.sub(r"\1", line) if linked else line
            kinds = list(map(_words.__getitem__, LETTERS.findall(shown)))
            n = len(kinds)
            bare = shown.lstrip(EDGE).rstrip(" \t*_")
            first, last = line[0], bare[-1:]
            capitals = kinds.count(2) + kinds.count(3)
            hits = 0 if code else kinds.count(1) + kinds.count(3)
            quote = first == ">"
            item = first in "-*+>" or first.isdigit() and line[1:2] in ".)0123456789"
            if n < 40:
                marks = MARK.findall(bare)
                digits = sum(map(str.isdigit, marks)) if marks else 0
                signs = sum(c in "©@↑✉" for c in marks) if marks else 0
                few = (len(marks) - digits - signs, digits, capitals > 0 and line.isupper(), len(linked), signs > 0, capitals / (n + 1))
            else:
                few = (0, 0, False, len(linked), False, 0.2)
            own.append((
                n, sum(map(len, linked)) / max(1, len(shown)) if linked else 0.0, hits, hits / (n + 1), first == "#", code, first == "|", item, last != "" and last in ".!?…”\"»", *few,
                quote + (quote and line[1:].lstrip()[:1] in "—–-"), first == "*" and line[1:2] not in "* " and line[-1] == "*" and bare != shown,
            ))
    if not number:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(FEATURES)))
    a, b, of_page = np.array(own, float), np.array(blocks), np.array(page)
    top = np.r_[True, of_page[1:] != of_page[:-1]]
    begin = np.flatnonzero(top)
    length = np.diff(np.r_[begin, len(b)])
    at = np.arange(len(b)) - np.repeat(begin, length)
    left = np.repeat(length, length) - 1 - at
    before, after = np.vstack([a[:1] * 0, a[:-1]]), np.vstack([a[1:], a[:1] * 0])
    before[at == 0] = 0
    after[left == 0] = 0
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    size = np.diff(np.r_[starts, len(b)])
    of = np.repeat(np.arange(len(starts)), size)
    mean = lambda x: (np.add.reduceat(x, starts) / size)[of]
    prose = ((a[:, 0] >= 10) & (a[:, 8] > 0) & (a[:, 3] < 0.25) | (a[:, 5] > 0) | (a[:, 6] > 0)).astype(int)
    total = np.repeat(np.add.reduceat(prose, begin), length)
    seen = np.cumsum(prose)
    seen = seen - np.repeat((seen - prose)[begin], length)
    features = np.column_stack([
        a[:, :14], before[:, 0], before[:, 1], before[:, 3], after[:, 0], after[:, 1], after[:, 3], size[of], mean(a[:, 0]), mean(a[:, 3]), mean(a[:, 1]),
        np.minimum(seen - prose, 3), np.minimum(total - seen, 3), np.minimum(at, 12), np.minimum(left, 12), a[:, 14:],
    ])
    return of_page, np.array(number), features


@dataclass(frozen=True)
class Tree:
    """A binary decision tree in arrays: at a leaf ``feature`` is -1 and ``value`` the share of furniture."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, depth: int = 10, leaf: int = 8) -> Tree:
        """Splits by the Gini impurity, down to ``depth`` and leaves of ``leaf`` lines."""
        nodes: list[list] = []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            share = float(y[rows].mean())
            nodes.append([-1, 0.0, -1, -1, share])
            if level == depth or len(rows) < 2 * leaf or share in (0.0, 1.0):
                return me
            best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
            for f in range(x.shape[1]):
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows[order], f], np.cumsum(y[rows[order]])
                n = np.arange(1, len(v) + 1)
                cut = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= leaf) & (len(v) - n[:-1] >= leaf))
                if not len(cut):
                    continue
                nl, tl = n[cut], t[cut]
                nr, tr = len(v) - nl, t[-1] - tl
                cost = tl * (nl - tl) / nl + tr * (nr - tr) / nr
                k = int(cost.argmin())
                if cost[k] < best[0]:
                    best = (float(cost[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                if low.all():
                    return me
                nodes[me][:4] = [best[1], best[2], grow(rows[low], level + 1), grow(rows[~low], level + 1)]
            return me

        grow(np.arange(len(y)), 0)
        table = np.array(nodes, float)
        return cls(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4])

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            rows = np.flatnonzero(inner)
            low = x[rows, f[rows]] <= self.threshold[at[rows]]
            at[rows] = np.where(low, self.left[at[rows]], self.right[at[rows]])


@dataclass(frozen=True)
class LineClassifier:
    """Tells the furniture lines of a page."""

    trees: tuple[Tree, ...]

    @classmethod
    def train(cls, pages: int = 500, trees: int = 15, seed: int = 11, keep=lambda language, style: True, without: tuple[str, ...] = ()) -> LineClassifier:
        """Fit ``trees`` trees, each on ``pages`` variants of the labelled pages that ``keep`` admits and on some of the features.

        The table is small, so one tree follows its accidents; the mean of several does not. ``without`` leaves out features by name.
        """
        grown = []
        for k in range(trees):
            xs, ys = [], []
            for page in labelled_blocks.pages(pages, seed + k, keep):
                xs.append("\n".join(line for line, _ in page))
                ys.extend(f for _, f in page if f is not None)
            seen = (np.random.default_rng(seed + k).random(len(FEATURES)) < 0.6) & ~np.isin(FEATURES, without)
            grown.append(Tree.fit(described(xs)[2] * seen, np.array(ys, float)))
        return cls(tuple(grown))

    def share(self, x: np.ndarray) -> np.ndarray:
        """How likely lines of these features are furniture."""
        return sum(t.predict(x) for t in self.trees) / len(self.trees)

    def furniture_of(self, texts: list[str]) -> list[list[int]]:
        """For each text the numbers of its non-blank lines that are not main content."""
        page, number, x = described(texts)
        gone = np.flatnonzero(self.share(x) >= 0.5) if len(x) else np.empty(0, np.int64)
        bounds = np.searchsorted(page[gone], np.arange(len(texts) + 1))
        return [number[gone[a:b]].tolist() for a, b in zip(bounds, bounds[1:])]

    def furniture(self, text: str) -> list[int]:
        """Numbers of the non-blank lines that are not main content."""
        return self.furniture_of([text])[0]


def _classify(model, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: LineClassifier = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                rows = [row for row, text in enumerate(texts) if len(WORD.findall(text)) >= min_words]
                page, number, x = described([texts[row] for row in rows])
                gone = np.flatnonzero(own.share(x) >= 0.5) if len(x) else np.empty(0, np.int64)
                ids = part.column(0).take(pa.array(np.array(rows, np.int64)[page[gone]]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number[gone].astype(np.int32))], ["id", "line_no"])

    return run


def furniture_lines(df: DataFrame, id_col: str, text_col: str, min_words: int = 60, model: LineClassifier | None = None) -> DataFrame:
    """(id, line_no): the non-blank lines, numbered from 1, that are not main content.

    Texts of fewer than ``min_words`` words, null texts and null ids give no rows. Rows that repeat
    an id and text count once. Other columns are ignored; an empty table gives an empty result.
    """
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("id is not null and text is not null")
    shared = df.sparkSession.sparkContext.broadcast(model or LineClassifier.train())
    found = spread(texts).mapInArrow(_classify(shared, min_words), f"id {texts.schema[0].dataType.simpleString()}, line_no int")
    return found.distinct()


def _extract(model, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: LineClassifier = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                rows = [row for row, text in enumerate(texts) if text and len(WORD.findall(text)) >= min_words]
                removed = np.zeros(len(texts), np.int32)
                for row, gone in zip(rows, own.furniture_of([texts[row] for row in rows])):
                    if gone:
                        left = set(gone)
                        texts[row] = "\n".join(x for k, x in enumerate(texts[row].split("\n"), 1) if k not in left)
                        removed[row] = len(gone)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(removed)], ["id", "text", "n_removed"])

    return run


def main_content(df: DataFrame, id_col: str, text_col: str, min_words: int = 60, model: LineClassifier | None = None) -> DataFrame:
    """(id, text, n_removed): each distinct row's text without its furniture; short texts stay whole, null stays null.

    The pass that has the text writes the cleaned one; only that is shuffled, once, to drop repeated rows. An id with several texts has a row for each.
    """
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("id is not null")
    shared = df.sparkSession.sparkContext.broadcast(model or LineClassifier.train())
    return spread(texts).mapInArrow(_extract(shared, min_words), f"id {texts.schema[0].dataType.simpleString()}, text string, n_removed int").distinct()

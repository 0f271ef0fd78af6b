"""Template residue, filler, error pages and scripts-required notices in place of content.

Labelled exemplars of all four kinds, and of ordinary text that resembles them, stand in an inverted
index by feature.  A text is read line by line and sentence by sentence; quoted passages are set
aside, as they are spoken about.  The features of a window retrieve exemplars, and the containment of
an exemplar in the window is weighed by the inverse document frequency of its features over all
documents.  Three kinds of features are held against three kinds of windows:

* messages, notices and filler phrases: words and pairs of neighbouring words.  A sentence is residue
  if an exemplar's containment in it, times the share of its own weight that words of that kind cover,
  is high, so that a sentence which merely mentions a message is none; so is one with a window of a
  long exemplar's length that holds it to a high degree;
* slots: the shape of a piece between two delimiters (which delimiters, how many words, capitals,
  digits, what is glued to what) and its words.  The heaviest exemplar contained in the piece gives
  its label, slot or ordinary.  A slot is excused if a window around it contains an exemplar of
  speaking about slots; each slot is judged for itself;
* filler that means nothing: groups of three letters.  A sentence, or a window of a long one, whose
  words are covered by the exemplars' groups to a high degree is residue.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeloom.llm import residue_exemplars as E

_QUOTED = re.compile(r"(?<![\w\"])\"[^\"\n]+\"|„[^„“”\n]+[“”]|“[^“”\n]+”|「[^」\n]+」|`[^`\n]+`|(?<!\w)[bfr]?'[^'\n]+'(?!\w)")
_QUOTE = re.compile(r"[\"„“「`']")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
_TOKEN = re.compile(r"[^\W_]+")
_FILL = re.compile(r"^x{2,}$")
#: Words (with inner marks), delimiters of template languages (runs of one mark, or these pairs), other marks.
_LEX = re.compile(r"[^\W_]+(?:[_.\-][^\W_]+)*|\$\{|\$\(|%\(|<%=?|%>|\{%|%\}|\[%|%\]|([{}\[\]<>«»$%@#&()○□;])\1*|_{2,}|[^\w\s]")
_DELIMITER = re.compile(r"[{}\[\]<>«»$%@#&()○□;]|__")
_OPENS = re.compile(r"[{\[<«$%@#&(○□]|__")
_CLOSES = "}])>»;"
_ALONE = re.compile(r"_{4,}|○{2,}|□{2,}")
LONG = 26  # letters (Hangul counting double) from which an exemplar is told inside any sentence
WINDOW = 16  # words of a long sentence whose letters are looked at together


def tokens(text: str) -> list[str]:
    """Lower-case words; runs of x become ``xx``, words with digits are left out."""
    out = []
    for t in _TOKEN.findall(text.lower()):
        if t[0] == "x" and _FILL.match(t):
            out.append("xx")
        elif t.isalpha() or not any(c.isdigit() for c in t):
            out.append(t)
    return out


def distinct_tokens(text: str) -> set[str]:
    """The set of ``tokens(text)``, and maybe words with digits."""
    out = set(_TOKEN.findall(text.lower()))
    if any(_FILL.match(t) for t in out if t[0] == "x"):
        out.add("xx")
    return out


def pairs(words: list[str]) -> list[str]:
    """Neighbouring words, as features."""
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


# ---- pieces between delimiters


def _size(words: list[str]) -> list[str]:
    """Names of the content's form: how many words, capitals, digits."""
    if any(c.isdigit() for w in words for c in w):
        return ["n"]
    if len(words) == 1 and all(len(x) == 1 for x in re.split(r"[_.\-]+", words[0])):
        return ["s"]
    form = "w" if len(words) == 1 else "w+"
    return [form, form.upper()] if "".join(words).isupper() else [form]


def pieces(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, features) of everything in the text that may be a slot: pieces of words between two delimiters, marks that stand alone.

    A piece goes as far as the next delimiter, whatever its length.
    """
    lex = [(m.group(0), m.start(), m.end()) for m in _LEX.finditer(text)]
    out, i = [], 0
    while i < len(lex):
        mark, start, end = lex[i]
        if not _DELIMITER.match(mark):
            i += 1
            continue
        glued = start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_")
        if _ALONE.fullmatch(mark):
            if not glued and not (mark[0] == "_" and end < len(text) and text[end].isalnum()):
                out.append((start, end, [_ALONE.sub(lambda m: m.group(0)[: 4 if m.group(0)[0] == "_" else 2], mark)]))
            i += 1
            continue
        j = i + 1
        while j < len(lex) and (lex[j][0][0].isalnum()):
            j += 1
        words = [w for w, _, _ in lex[i + 1 : j]]
        if mark == "%" and not (words and j < len(lex) and lex[j][0] == "%" and lex[j][1] == lex[j - 1][2] and lex[i + 1][1] == end):
            if words and lex[i + 1][1] == end and not glued:  # a format mark, unless a number stands before it
                number = i > 0 and lex[i - 1][0][0].isdigit()
                out.append((start, lex[i + 1][2], [("9 %" if number else "%") + words[0]]))
            i += 1
            continue
        if mark[0] not in _CLOSES and words and j < len(lex) and (lex[j][0] == mark or lex[j][0][-1] in _CLOSES):
            close, at, stop = lex[j]
            need = 1 if mark in ("$(", "${", "%(") else len(mark)
            if len(set(close)) == 1 and len(close) > need:  # more marks close what stands around it
                close, stop = close[:need], at + need
            loose = (" " if lex[i + 1][1] > end else "", " " if at > lex[j - 1][2] else "")
            strong = mark == "«" or len(mark) > 1 and (len(close) > 1 or mark[0] in "$%")
            after = stop < len(text) and text[stop].isalnum()
            if mark == "%(" and after:
                close, stop = close + text[stop], stop + 1
            edge = "" if strong else ("·" if glued else "") + ("·" if after and close in ("#", "$", "%") else "")
            out.append((start, stop, [f"{edge}{mark}{loose[0]}{x}{loose[1]}{close}" for x in ["…", *([] if strong else _size(words))]] + [w.lower() for w in words]))
            i = j + 1
            continue
        i = max(i + 1, j)
    return out


def _slot_exemplars() -> list[tuple[str, list[str]]]:
    """(label, features) of the exemplars of slots and of ordinary pieces."""
    out = []
    for label, passages in (("slot", E.SLOTS), ("ordinary", E.ORDINARY)):
        for p in passages.split("\n") if label == "slot" else passages.split():
            if not p.strip():
                continue
            _, _, found = max(pieces(p.strip()), key=lambda x: (x[1] - x[0], len(x[2])))
            shape = [f for f in found if not f[0].isalnum() or len(found) == 1]
            words = [f for f in found if f not in shape and f != "name"]
            if label == "ordinary" or not words:
                # a bare name: the most specific form; an ordinary piece: form and word
                form = shape[-1:] if label == "slot" else shape[1:2] or shape[:1]
                out.append((label, form + words))
            else:
                out.append((label, shape[:1] + words))
    return out


# ---- exemplars


def _passages(text: str) -> list[str]:
    return [" ".join(p.split()) for p in text.strip().splitlines() if p.strip()]


def _by_kind() -> list[tuple[str, list[str]]]:
    seen, out = set(), []
    for kind, text in (("error", E.ERRORS), ("scripts", E.SCRIPTS), ("filler", E.FILLER)):
        for p in _passages(text):
            words = tokens(p)
            if words and (kind, *words) not in seen:
                seen.add((kind, *words))
                out.append((kind, words))
    return out


#: (kind, tokens) of the exemplars of messages, notices and filler phrases; (label, features) of pieces; tokens of talk about slots.
EXEMPLARS = _by_kind()
PIECES = _slot_exemplars()
MENTIONS = [tokens(p) for p in _passages(E.MENTIONS)]
WORDS = frozenset(t for _, p in EXEMPLARS for t in p) | frozenset(t for p in MENTIONS for t in p)
PAIRS = frozenset(f for _, p in EXEMPLARS for f in pairs(p))
SHAPES = frozenset(f for _, p in PIECES for f in p)
_FOLLOWING: dict[str, set[str]] = defaultdict(set)
for _pair in PAIRS:
    _FOLLOWING[_pair.split(" ")[0]].add(_pair.split(" ")[1])
OF_KIND = {k: frozenset(t for kind, p in EXEMPLARS if kind == k for t in p) for k in ("error", "scripts", "filler")}
_LETTERS = frozenset(f" {w} "[i : i + 3] for w in tokens(E.NONSENSE) for i in range(len(w)))


@lru_cache(maxsize=200_000)
def letters_covered(word: str) -> float:
    """Share of the word's groups of three letters, its ends included, that the exemplars of meaningless filler hold."""
    padded = f" {word} "
    return sum(padded[i : i + 3] in _LETTERS for i in range(len(word))) / len(word)


def corpus_features(text: str) -> set[str]:
    """The exemplars' features that the text holds."""
    words = _TOKEN.findall(text.lower())
    out = set(words) & WORDS
    if not out.isdisjoint(_FOLLOWING):
        after = _FOLLOWING.get
        out.update(f"{a} {b}" for a, b in zip(words, words[1:]) if (ends := after(a)) and b in ends)
    if _OPENS.search(text):
        for line in text.splitlines():
            if _OPENS.search(line):
                out.update("\0" + f for _, _, found in pieces(line) for f in found if f in SHAPES)
    return out


class Weights:
    """Inverse document frequencies over the corpus, the exemplars' weights, and the inverted index.

    The index lists an exemplar under its rarest words, as many as weigh, with the pairs they stand in,
    more than what a match may lack; a sentence without any of them cannot reach ``least``, so none is missed.
    """

    def __init__(self, documents: int, found: dict[str, int], coverage: float = 0.8, least: float = 0.42):
        def idf(f: str) -> float:
            return math.log((documents + 1) / (found.get(f, 0) + 1)) + 1.0

        self.coverage = coverage
        self.idf = {f: idf(f) for f in WORDS | PAIRS}
        self.shape_idf = {f: idf("\0" + f) for f in SHAPES}
        #: weight of a word that no exemplar holds: as of one in a hundredth of the documents
        self.unknown = math.log((documents + 1) / (documents / 100 + 1)) + 1.0
        self.want = [Counter(p) + Counter(pairs(p)) for _, p in EXEMPLARS]
        self.total = [sum(self.idf[f] * n for f, n in w.items()) for w in self.want]
        self.least = least
        self.index: dict[str, list[int]] = defaultdict(list)
        for i, (_, p) in enumerate(EXEMPLARS):
            left = Counter(self.want[i])
            lack = (1 - least) * self.total[i]
            for t in sorted(set(p), key=lambda t: (-self.idf[t], t)):
                self.index[t].append(i)
                gone = [f for f in left if t in f.split(" ")]
                lack -= sum(self.idf[f] * left.pop(f) for f in gone)
                if lack < 0:
                    break
        self.pieces: dict[str, list[int]] = defaultdict(list)
        for i, (_, p) in enumerate(PIECES):
            self.pieces[max(p, key=lambda f: (self.shape_idf[f], f))].append(i)
        self.piece_total = [sum(self.shape_idf[f] for f in p) for _, p in PIECES]
        self.alone = [sum(2 if c >= "가" else 1 for c in " ".join(p)) >= LONG for _, p in EXEMPLARS]
        self.about = [(len(p), Counter(t for t in p if t != "slot")) for p in MENTIONS]
        self.about_total = [sum(self.idf[t] * n for t, n in c.items()) for _, c in self.about]

    def within_reach(self, distinct: set[str]) -> list[int]:
        """Exemplars that a sentence of these words, in the best order, could hold to the degree ``least``."""
        out = []
        for i in {i for t in distinct & self.index.keys() for i in self.index[t]}:
            if sum(self.idf[f] * n for f, n in self.want[i].items() if (f in distinct if " " not in f else distinct.issuperset(f.split(" ")))) >= self.least * self.total[i]:
                out.append(i)
        return sorted(out)

    def contained(self, exemplar: int, have: Counter) -> float:
        """Share of the exemplar's weight that the features hold."""
        return sum(self.idf[f] * min(n, have[f]) for f, n in self.want[exemplar].items()) / self.total[exemplar]

    def label(self, features: list[str]) -> str | None:
        """Label of the heaviest exemplar of pieces that the features contain."""
        have = set(features)
        best, name = 0.0, None
        for i in {i for f in have & self.pieces.keys() for i in self.pieces[f]}:
            label, p = PIECES[i]
            held = sum(self.shape_idf[f] for f in p if f in have)
            if held >= self.coverage * self.piece_total[i] and (held, label == "slot") > (best, False):
                best, name = held, label
        return name

    def spoken_about(self, words: list[str], at: int) -> float:
        """Highest share of a mention's weight, the slot itself not counted, that a window of its length around the slot at ``at`` holds."""
        most = 0.0
        here = set(words)
        for (n, want), total in zip(self.about, self.about_total):
            if sum(self.idf[t] * c for t, c in want.items() if t in here) <= most * total:
                continue
            for a in range(max(0, at - n + 1), at + 1):
                have = Counter(words[a : a + n])
                most = max(most, sum(self.idf[t] * min(c, have[t]) for t, c in want.items()) / total)
        return most

    def covered(self, kind: str, words: list[str]) -> float:
        """Share of the sentence's weight that words of the kind's exemplars cover."""
        mine = OF_KIND[kind]
        all_of = [self.idf.get(t, self.unknown) for t in words]
        return sum(x for t, x in zip(words, all_of) if t in mine) / sum(all_of)


def has_slot(sentence: str, w: Weights, mention: float) -> bool:
    """Whether an unfilled slot stands in the sentence that is not spoken about."""
    found = [(a, b) for a, b, features in pieces(sentence) if w.label(features) == "slot"]
    if not found:
        return False
    words: list[str] = []
    at, last = [], 0
    for a, b in found:
        if a < last:
            continue
        words += tokens(sentence[last:a])
        at.append(len(words))
        words.append("slot")
        last = b
    words += tokens(sentence[last:])
    return any(w.spoken_about(words, k) < mention for k in at)


def phrase_kind(words: list[str], w: Weights, sentence: float) -> str | None:
    """Kind of the message, notice or filler phrase that the sentence holds."""
    near = w.within_reach(set(words))
    if not near:
        return None
    both = pairs(words)
    have = Counter(words + both)
    covered: dict[str, float] = {}
    for i in near:
        held = w.contained(i, have)
        kind, p = EXEMPLARS[i]
        if held < (w.coverage if len(p) <= 2 else sentence):  # two words apart say little
            continue
        if kind not in covered:
            covered[kind] = w.covered(kind, words)
        if held * covered[kind] >= sentence:
            return kind
        if held >= w.coverage and w.alone[i]:
            inside, size = set(p), len(p) + 1
            for a, t in enumerate(words):
                if t in inside and w.contained(i, Counter(words[a : a + size] + both[a : a + size - 1])) >= w.coverage:
                    return kind
    return None


def is_meaningless(words: list[str], share: float) -> bool:
    """Whether the letters of the words, or of a window of them, are those of meaningless filler."""
    if len(words) < 3:
        return False
    known = [letters_covered(t) for t in words]
    for a in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2):
        part, name = known[a : a + WINDOW], words[a : a + WINDOW]
        weight = [len(t) for t in name]
        if len(part) >= 3 and sum(x >= 0.7 for x in part) >= 3 and sum(x * n for x, n in zip(part, weight)) >= share * sum(weight):
            return True
    return False


def residue_kinds(text: str | None, w: Weights, mention: float = 0.6, sentence: float = 0.42, letters: float = 0.8) -> set[str]:
    """All kinds of residue in the whole text."""
    out: set[str] = set()
    if not text:
        return out
    distinct = distinct_tokens(text)
    anchors = distinct & w.index.keys()
    strange = {t for t in distinct if (len(t) > 4 or t == "xx") and letters_covered(t) >= 0.7}
    wanted = [t for t in anchors | strange if t != "xx"]
    for line, low in zip(text.splitlines(), text.lower().splitlines()):
        opens = _OPENS.search(line)
        known = odd = False
        if ("xx" in distinct and "xx" in low) or any(t in low for t in wanted):
            every = _TOKEN.findall(low)
            here = set(every)
            if any(t[0] == "x" and _FILL.match(t) for t in here):
                here.add("xx")
            known = not anchors.isdisjoint(here)
            # a meaningless passage has three covered words or more
            odd = not strange.isdisjoint(here) and ("xx" in here or sum(letters_covered(t) >= 0.7 for t in every) >= 3)
        if not (opens or known or odd):
            continue  # nothing in this line can be residue
        bare = _QUOTED.sub(" ¤ ", line) if _QUOTE.search(line) else line
        for s in _SENTENCE.split(bare):
            if opens and "slot" not in out and _OPENS.search(s) and has_slot(s, w, mention):
                out.add("slot")
            if known or odd:
                words = tokens(s)
                if known and not anchors.isdisjoint(words) and (kind := phrase_kind(words, w, sentence)):
                    out.add(kind)
                if odd and "filler" not in out and not strange.isdisjoint(words) and is_meaningless(words, letters):
                    out.add("filler")
    return out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("_text").to_pylist():
            if text:
                counts[""] += 1
                counts.update(corpus_features(text))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])


def corpus_weights(texts: DataFrame, coverage: float = 0.8, least: float = 0.42) -> Weights:
    """Document frequencies of the exemplars' features over all rows of ``texts`` (column ``_text``); as many rows as there are features come back."""
    rows = texts.select("_text").mapInArrow(_document_counts, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = {r[0]: r[1] for r in rows}
    return Weights(found.pop("", 0), found, coverage, min(coverage, least))


def find_residue(df: DataFrame, ident: str, text: str, *, coverage: float = 0.8, mention: float = 0.6, sentence: float = 0.42, letters: float = 0.8) -> DataFrame:
    """(doc_id, kinds) of the texts that hold residue; kinds are slot, filler, error, scripts, sorted.

    ``coverage``: containment of an exemplar in a window; ``sentence``: containment in a whole sentence
    times the share of the sentence that words of the kind cover; ``letters``: share of a meaningless passage's letters; ``mention``: containment of
    an exemplar of speaking about slots.

    * NULL, empty and blank texts are no case. Texts, lines and sentences of any length are read whole.
    * A repeated row gives a repeated result; an empty table gives no rows. Other columns are not read.
    * Equal coverage counts: a window at exactly ``coverage`` is residue, a slot whose
      window is at exactly ``mention`` is spoken about.
    """
    rows = df.select(F.col(ident).alias("doc_id"), F.col(text).alias("_text"))
    weights = corpus_weights(rows, coverage, sentence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [sorted(residue_kinds(t, weights, mention, sentence, letters)) for t in batch.column("_text").to_pylist()]
            keep = [i for i, k in enumerate(kinds) if k]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array([kinds[i] for i in keep], pa.list_(pa.string()))], ["doc_id", "kinds"]
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kinds array<string>")


def without_residue(df: DataFrame, ident: str, text: str, **how) -> DataFrame:
    """The rows of ``df`` that hold no residue."""
    found = find_residue(df, ident, text, **how).select(F.col("doc_id").alias(ident)).distinct()
    return df.join(found, ident, "left_anti")

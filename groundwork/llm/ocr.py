"""Texts from scanned pages repaired into continuous paragraphs, and the kinds of noise found in them.

Evidence is counted over the whole corpus first: words and pairs of neighbouring words, words that
carry a hyphen inside a line, and lines that recur as running headers. Every word is then looked up by
intersecting a Levenshtein automaton with the trie of the vocabulary. The automaton has substitutions,
insertions, deletions, merges and splits, so all vocabulary words within its distance are found.
Candidates rank by the kind of edit (signs of one shape first), then by context: how often the corpus
has them between the same neighbours, then by how often it has them at all. A candidate by shapes counts
if it is far commoner than the word; any other edit may as well be an inflection or another word, so it
counts only inside a word, for a rare word, and if the neighbours on both sides speak for it. Then page
furniture is removed and lines are joined.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.session import cut, table

#: A candidate must be this much commoner than the word, and seen so often; shorter words are not judged.
RATIO, LEAST_SEEN, LEAST_LETTERS = 12, 5, 4
#: Rows of each learned table that may travel to the tasks (the commonest ones, if there were more).
LEARNED_ROWS = 400_000
#: A line with the game's name is a running header if its form recurs in so many chunks; any other line if it
#: begins or ends chunks of one game on so many combinations of page and neighbouring line.
HEADER_SEEN, EDGE_WAYS = 3, 6
#: Least share that an edge line has in all places where two of its words stand side by side.
EDGE_SHARE = 0.1
#: A word by other edits than of shapes: so rare, so long, the edit so far from its end, and the candidate's
#: neighbours so often seen on either side.
RARE, LONG, ENDING, NEIGHBOURS = 2, 6, 3, 3

#: Signs that divide a word at a line end, and words before which a hyphen stays.
HYPHENS = "-‐‑¬­"
JOINERS = {"und", "oder", "bzw", "sowie", "and", "or", "et", "ou", "beziehungsweise"}
#: Signs of one shape, as sets; and pairs that look like one letter.
SHAPES = ["ce", "co", "eo", "ij", "il1|!í", "jl", "gq9", "o0", "s5$§", "bh6", "b8ß", "t†f+7", "uv", "nu", "nh", "a@", "z2", "vy", "mn", "rn", "kx", "d0"]
MERGED = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("ri", "n"), ("in", "m"), ("nn", "m")]

TOKEN = re.compile(r"[^\s.,;:!?()\[\]{}\"“”„«»‚‘’…/·–—=<>*#%&~^`´]+(?:[|!†§$@](?=[^\W\d_])[^\s.,;:!?()\[\]\"“”„«»…]*)?", re.UNICODE)
NUMBER_LINE = re.compile(r"^\W*(?:(?:Seite|Page|S\.|p\.)\s*)?(\d{1,4})\W*$", re.IGNORECASE)
PLAIN_NUMBER = re.compile(r"^\d+$")


def similar() -> dict[str, str]:
    """For each sign the signs that it may have been read for."""
    out: dict[str, set] = {}
    for group in SHAPES:
        for c in group:
            out.setdefault(c, set()).update(x for x in group if x != c)
    return {c: "".join(sorted(v)) for c, v in out.items()}


SIMILAR = similar()


class Trie:
    """The vocabulary, with counts and languages, and the Levenshtein automaton of a word run along it."""

    def __init__(self, words: dict[str, tuple[int, str]]):
        self.root: dict = {}
        for w, n in words.items():
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = n

    def candidates(self, word: str, edits: int = 1, lang: str = "", most: int | None = None) -> list[tuple[bool, int, str, int]]:
        """(by shapes, count, word, place of the last other edit) of all vocabulary words of the language within 1 to ``edits`` edits.

        ``most`` other edits than those of shapes are allowed (all, if null). By shapes first, the commonest first.
        """
        found: dict[str, tuple[bool, int, int]] = {}
        most = edits if most is None else most
        # states of the automaton: (place in the word, edits left, other edits left, place of the last of these), with its node and path
        stack = [(self.root, 0, edits, most, -1, "")]
        seen = set()
        while stack:
            state = stack.pop()
            node, k, left, other, at, path = state
            if (path, k, left, other) in seen:
                continue
            seen.add((path, k, left, other))
            if k == len(word):
                if "" in node and left < edits and ("" in (lang, node[""][1]) or lang == node[""][1]):
                    new = (other == most, node[""][0], at)
                    if path not in found or new > found[path]:
                        found[path] = new
            else:
                c = word[k]
                if c in node:
                    stack.append((node[c], k + 1, left, other, at, path + c))
                if left:
                    for x in SIMILAR.get(c, ""):
                        if x in node:
                            stack.append((node[x], k + 1, left - 1, other, at, path + x))
                    for many, one in MERGED:
                        if word.startswith(many, k) and one in node:
                            stack.append((node[one], k + len(many), left - 1, other, at, path + one))
                        if c == one and many[0] in node and many[1] in node[many[0]]:
                            stack.append((node[many[0]][many[1]], k + 1, left - 1, other, at, path + many))
                    if other:
                        stack.append((node, k + 1, left - 1, other - 1, k, path))
                        for x, child in node.items():
                            if x and x != c:
                                stack.append((child, k + 1, left - 1, other - 1, k, path + x))
            if left and other:
                for x, child in node.items():
                    if x:
                        stack.append((child, k, left - 1, other - 1, k, path + x))
        found.pop(word, None)
        return sorted(((shape, n, w, at) for w, (shape, n, at) in found.items()), key=lambda x: (not x[0], -x[1], x[2]))


def tokens(text: str) -> list[str]:
    """Words as they stand, hyphens and misread signs inside them included, without signs at their ends."""
    out = []
    for m in TOKEN.finditer(text):
        w = m.group()
        if w.isalpha():
            out.append(w)
            continue
        w = w.strip("-‐‑¬_'|!+")
        if any(c.isalpha() for c in w):
            out.append(w)
    return out


def parts(word: str) -> list[str]:
    low = word.lower()
    return [low] if low.isalpha() else [p for p in re.split(r"[-‐‑'’]", low) if p]


#: Umlauts as names in keys have them.
SPELLINGS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue"})


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold().translate(SPELLINGS)


def near(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


@lru_cache(maxsize=10_000)
def _name(game: str) -> tuple[str, tuple[str, ...]]:
    name = folded(game).split("-")[0]
    k = max(1, len(name) // 3)
    return name, (name[:k], name[k : 2 * k], name[2 * k :])


def header_form(line: str, game: str | None) -> str | None:
    """A short line that has the game's name (of which its key begins with the first word), with name and page number masked; else null."""
    s = line.strip()
    if not game or not 3 < len(s) <= 70:
        return None
    name, thirds = _name(game)
    plain = folded(s)
    # up to two edits leave one third of the name whole
    if not name or not any(t in plain for t in thirds):
        return None
    words = re.findall(r"[^\s|·–—]+", plain)
    if not words or len(words) > 9:
        return None
    most = 0 if len(name) < 4 else 1 if len(name) < 8 else 2
    hit = False
    out = []
    for w in words:
        if not hit and (w == name or (len(w) > 4 and near(w, name, most))):
            out.append("@")
            hit = True
        elif not re.fullmatch(r"\W*\d+\W*", w):
            out.append(w)
    if not hit:
        return None
    if out and out[-1] in ("seite", "page") and len(out) > 2:
        out = out[:-1]
    return " ".join(out) if len(out) > 1 else None


def edge_form(line: str) -> str | None:
    """A short line of several words that ends no sentence, with numbers masked; else null."""
    s = line.strip()
    if not 5 < len(s) <= 70 or s[-1] in ".!?:;,…" or NUMBER_LINE.match(s):
        return None
    words = re.sub(r"\d+", "#", s.lower()).split()
    return " ".join(words) if 2 <= len(words) <= 9 and sum(any(c.isalpha() for c in w) for w in words) >= 2 else None


def page_lines(lines: list[str], page: int | None) -> list[bool]:
    """Which lines are the page number alone; values of a table, standing in a column, are none."""
    out = [False] * len(lines)
    if page is None:
        return out
    full = [k for k, x in enumerate(lines) if x.strip()]
    at = {k: i for i, k in enumerate(full)}
    for k in full:
        s = lines[k].strip()
        m = NUMBER_LINE.match(s)
        if not m or int(m.group(1)) != page:
            continue
        if PLAIN_NUMBER.match(s):
            i = at[k]
            above = lines[full[i - 1]].strip() if i else ""
            below = lines[full[i + 1]].strip() if i + 1 < len(full) else ""
            if PLAIN_NUMBER.match(above) or PLAIN_NUMBER.match(below) or above.endswith(":"):
                continue
        out[k] = True
    return out


class Knowledge:
    """What was counted and learned over the corpus."""

    def __init__(self, misread: dict[str, str], hyphened: set[str], headers: set[str], edges: set[str]):
        self.misread, self.hyphened, self.headers, self.edges = misread, hyphened, headers, edges
        self.judged: dict[str, bool] = {}
        self.lengths: dict[int, list[str]] = {}
        for h in headers:
            self.lengths.setdefault(len(h), []).append(h)

    def header(self, line: str, game: str | None) -> bool:
        f = header_form(line, game)
        if f is None:
            return bool(self.edges) and game is not None and (e := edge_form(line)) is not None and f"{game}\n{e}" in self.edges
        if f in self.headers:
            return True
        # a header may be misread itself
        return any(near(f, h, 2) for n in range(len(f) - 2, len(f) + 3) for h in self.lengths.get(n, ()) if f.find("@") == h.find("@") or f.rfind("@") - len(f) == h.rfind("@") - len(h))

    def wrong(self, word: str) -> bool:
        known = self.judged.get(word)
        if known is None:
            if len(self.judged) > 200_000:
                self.judged.clear()
            known = self.judged[word] = any(p in self.misread for p in parts(word))
        return known


def divided(head: str, tail: str, known: Knowledge | None) -> bool:
    """Whether the sign at the end of ``head``'s line is no part of the word that goes on in ``tail``."""
    sign = head[-1]
    if sign in "¬­":
        return True
    before = re.search(r"[^\W\d_][\w'’-]*$", head[:-1])
    after = re.match(r"[^\W\d_][\w'’-]*", tail)
    if not before or not after:
        return False
    a, b = before.group(), after.group()
    if b.lower() in JOINERS:
        return False
    if known and (a + "-" + b).lower() in known.hyphened:
        return False
    if b[0].islower():
        return True
    return len(a) > 1 and a.isupper() and b.isupper()


def examine(text: str | None, page: int | None, game: str | None, known: Knowledge) -> tuple[list[str], str]:
    """(kinds of noise, repaired text) of one chunk."""
    if not text or not text.strip():
        return [], ""
    lines = re.split(r"\r\n|\r|\n", text)
    numbers = page_lines(lines, page)
    kinds: set[str] = set()
    kept: list[str] = []
    removed_words: list[str] = []
    for k, line in enumerate(lines):
        if numbers[k]:
            kinds.add("seitenzahl")
            continue
        if known.header(line, game) and len(lines) > 1:
            kinds.add("kopfzeile")
            found = [int(x) for x in re.findall(r"(?:^\D{0,3}|\D\s|\|\s*)(\d{1,4})\W*$|^\W*(\d{1,4})\s", line.strip()) for x in x if x]
            if page is not None and page in found:
                kinds.add("seitenzahl")
            removed_words += tokens(line)
            continue
        kept.append(line)
    out: list[str] = []
    paragraph = ""
    for k, line in enumerate(kept):
        s = line.strip()
        if not s:
            # furniture between two halves of a sentence leaves a blank line that is none
            if paragraph and paragraph[-1] not in HYPHENS:
                out.append(paragraph)
                paragraph = ""
            continue
        if not paragraph:
            paragraph = s
        elif paragraph[-1] in HYPHENS and len(paragraph) > 1 and paragraph[-2].isalpha():
            if divided(paragraph, s, known):
                kinds.add("trennung")
                paragraph = paragraph[:-1] + s
            elif re.match(r"(?:\w+)", s) and re.match(r"\w+", s).group().lower() in JOINERS:
                paragraph += " " + s
            else:
                paragraph += s
        else:
            paragraph += " " + s
    if paragraph:
        out.append(paragraph)
    whole = "\n\n".join(out)
    if any(known.wrong(w) for w in [*tokens(whole), *removed_words]):
        kinds.add("zeichen")

    if "zeichen" not in kinds:
        return sorted(kinds), whole

    def right(m: re.Match) -> str:
        w = m.group()
        for p in set(parts(w)):
            v = known.misread.get(p)
            if v:
                shape = v.upper() if w.isupper() else v.capitalize() if w[:1].isupper() else v
                w = re.sub(re.escape(p), shape, w, flags=re.IGNORECASE)
        return w

    return sorted(kinds), TOKEN.sub(right, whole)


JOIN = re.compile(rf"([^\W\d_])[{HYPHENS}]\s*\n\s*(?=[a-zß-ÿ])")


class Counts:
    """Words, pairs of neighbouring words and lines of a batch of texts, counted over arrays."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.split: dict[str, list[int]] = {}
        self.words: list[int] = []
        self.ends: list[int] = []
        self.langs: list[str] = []
        self.rows: dict[tuple[str, str, str], int] = {}

    def add(self, kind: str, word: str, lang: str) -> None:
        k = (kind, word, lang)
        self.rows[k] = self.rows.get(k, 0) + 1

    def text(self, text: str, game: str | None, page: int | None, lang: str | None) -> None:
        if "\n" in text or "\r" in text:
            lines = [x for x in re.split(r"\r\n|\r|\n", text) if x.strip()]
            for form in {header_form(x, game) for x in lines} - {None}:
                self.add("header", form, "")
            if game is not None and len(lines) > 1:
                for line, beside in ((lines[0], lines[1]), (lines[-1], lines[-2])):
                    if form := edge_form(line):
                        self.add("edge", f"{game}\n{form}", f"{page} {beside.strip()}")
            text = JOIN.sub(r"\1", text)
        for w in tokens(text):
            ids = self.split.get(w)
            if ids is None:
                if "-" in w:
                    self.rows.setdefault(("hyphen", w.lower(), ""), 0)
                ids = self.split[w] = [self.number.setdefault(p, len(self.number)) for p in parts(w)]
            if "-" in w:
                self.rows[("hyphen", w.lower(), "")] += 1
            self.words += ids
        self.ends.append(len(self.words))
        self.langs.append(lang or "")

    def batch(self) -> pa.RecordBatch:
        names = list(self.number)
        w = np.array(self.words, np.int64)
        size = np.diff(np.array([0, *self.ends], np.int64))
        langs, of = np.unique(np.array(self.langs, dtype=object).astype(str), return_inverse=True)
        # words of enough letters, by language
        long = np.array([len(x) >= LEAST_LETTERS for x in names], bool)
        code, n = np.unique(w * len(langs) + np.repeat(of, size), return_counts=True)
        keep = long[code // len(langs)] if len(code) else np.empty(0, bool)
        code, n = code[keep], n[keep]
        kind, word, lang, count = ["word"] * len(code), [names[i] for i in code // len(langs)], [str(langs[i]) for i in code % len(langs)], n.tolist()
        # neighbours inside one text
        inside = np.ones(max(len(w) - 1, 0), bool)
        ends = np.array(self.ends, np.int64)
        ends = ends[(ends > 0) & (ends < len(w))]
        inside[ends - 1] = False
        pair, n = np.unique((w[:-1] * len(names) + w[1:])[inside], return_counts=True) if len(w) > 1 else (w[:0], w[:0])
        kind += ["pair"] * len(pair)
        word += [names[i] for i in pair // max(len(names), 1)]
        lang += [names[i] for i in pair % max(len(names), 1)]
        count += n.tolist()
        for (k, x, y), n in self.rows.items():
            kind.append(k)
            word.append(x)
            lang.append(y)
            count.append(n)
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(word, pa.string()), pa.array(lang, pa.string()), pa.array(count, pa.int64())], names=["kind", "word", "lang", "n"])


#: Words that a task counts before it passes the counts on.
HELD_WORDS = 2_000_000


def counted(chunks: DataFrame) -> DataFrame:
    """(kind, word, lang, n): ``word`` by language, ``pair`` with the next word, ``hyphen``, ``header`` forms, ``edge`` lines by page and neighbour."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counts()
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                c.text(*row)
                if len(c.words) > HELD_WORDS:
                    yield c.batch()
                    c = Counts()
        if c.ends:
            yield c.batch()

    page = F.coalesce("seite", "seite_pdf")
    rows = chunks.where("text is not null").select("text", "spiel_id", page, F.lower(F.trim("sprache"))).mapInArrow(run, "kind string, word string, lang string, n bigint")
    return rows.groupBy("kind", "word", "lang").agg(F.sum("n").alias("n"))


def bounded(df: DataFrame, what: str, rows: int = LEARNED_ROWS) -> list:
    """The rows of a table that travels to the tasks; more than ``rows`` are an error, for none may be dropped."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} {what}: raise ocr.LEARNED_ROWS (and the executors' memory) for this corpus")
    return got


def recurring(lines: list, pairs: DataFrame) -> set[str]:
    """Those edge lines whose words the corpus hardly has side by side elsewhere; the others are phrases of the text where a page happened to break."""
    found = []
    for line in lines:
        w = [p for t in tokens(line["word"].partition("\n")[2]) for p in parts(t)]
        found += [(line["word"], line["n"], a, b) for a, b in zip(w, w[1:])]
    if not found:
        return set()
    asked = pairs.sparkSession.createDataFrame(found, "line string, n bigint, a string, b string")
    least = asked.join(pairs, ["a", "b"]).groupBy("line", "n").agg(F.min("k").alias("k"))
    return {r["line"] for r in least.where(F.col("n") >= EDGE_SHARE * F.col("k")).collect()}


def learn(chunks: DataFrame) -> tuple[dict[str, str], set[str], set[str], set[str]]:
    """(misread words with what they were, words with a hyphen of their own, forms of running headers, recurring edge lines)."""
    by = cut(counted(chunks))
    sums = by.where("kind <> 'pair'").groupBy("kind", "word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ways"), F.coalesce(F.max_by("lang", F.when(F.col("lang") != "", F.col("n"))), F.lit("")).alias("lang"))
    # a word belongs to the language that has it most, if labelled at all
    words = sums.where("kind = 'word'").select("word", "n", "lang")
    headers = {r["word"] for r in bounded(sums.where((F.col("kind") == "header") & (F.col("n") >= HEADER_SEEN)).select("word"), "headers")}
    pairs = by.where("kind = 'pair'").select(F.col("word").alias("a"), F.col("lang").alias("b"), F.col("n").alias("k"))
    edges = recurring(bounded(sums.where((F.col("kind") == "edge") & (F.col("ways") >= EDGE_WAYS)).select("word", "n"), "edge lines"), pairs)
    hyphened = {r["word"] for r in bounded(sums.where("kind = 'hyphen' and n >= 2").select("word"), "words with a hyphen")}
    usual = (F.col("n") >= LEAST_SEEN * RATIO // 4) & F.col("word").rlike(r"^\p{L}+$")
    common = {r["word"]: (r["n"], r["lang"]) for r in bounded(words.where(usual), "common words")}
    shared = chunks.sparkSession.sparkContext.broadcast(common)
    held: list[Trie] = []

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Trie(shared.value))
        for batch in batches:
            out: list[tuple] = []
            for word, n, lang in zip(*(c.to_pylist() for c in batch.columns)):
                odd = not word.isalpha()
                rare = not odd and n <= RARE and len(word) >= LONG
                for shape, m, v, at in held[0].candidates(word, 2 if odd else 1, lang, 1 if rare else 0):
                    if m < LEAST_SEEN:
                        continue
                    if shape and m >= (2 if odd else RATIO) * n or not shape and rare and 0 < at < len(word) - ENDING and m >= RATIO * RATIO * n:
                        out.append((word, v, shape, m))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["word", "right", "shape", "m"])

    found = cut(words.repartition("word").mapInArrow(look, "word string, right string, shape boolean, m bigint"))
    # how often the corpus has a candidate between the word's own neighbours
    asked = found.select("word").distinct()
    before = pairs.join(asked.withColumnRenamed("word", "b"), "b").select(F.col("b").alias("word"), F.col("a").alias("beside"))
    after = pairs.join(asked.withColumnRenamed("word", "a"), "a").select(F.col("a").alias("word"), F.col("b").alias("beside"))
    left = found.join(before, "word").join(pairs.select(F.col("a").alias("beside"), F.col("b").alias("right"), "k"), ["beside", "right"]).groupBy("word", "right").agg(F.sum("k").alias("links"))
    right = found.join(after, "word").join(pairs.select(F.col("a").alias("right"), F.col("b").alias("beside"), "k"), ["beside", "right"]).groupBy("word", "right").agg(F.sum("k").alias("rechts"))
    ranked = found.join(left, ["word", "right"], "left").join(right, ["word", "right"], "left").na.fill(0, ["links", "rechts"])
    fits = F.col("shape") | ((F.col("links") >= NEIGHBOURS) & (F.col("rechts") >= NEIGHBOURS))
    # a candidate seen on both sides before one seen on one, then by counts
    score = F.struct("shape", (F.least(F.col("links"), F.lit(1)) + F.least(F.col("rechts"), F.lit(1))).alias("sides"), (F.log1p("links") + F.log1p("rechts") + F.log1p("m")).alias("s"), "m", "right")
    best = ranked.where(fits).groupBy("word").agg(F.max_by("right", score).alias("right"))
    misread = {r["word"]: r["right"] for r in bounded(best, "misread words")}
    return misread, hyphened, headers, edges


def repaired(chunks: DataFrame) -> DataFrame:
    """(id, stoerungen, repariert): the kinds of noise of every chunk and its text in continuous paragraphs.

    ``chunks`` has ``id, spiel_id, seite, seite_pdf, sprache, text``. Null, empty and blank texts have no noise
    and give the empty text; without any page no line can be a page number, without a game none a
    running header. A repeated row gives its result again, an empty table none.
    """
    known = chunks.sparkSession.sparkContext.broadcast(learn(chunks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = Knowledge(*known.value)
        for batch in batches:
            d = batch.to_pydict()
            rows = [examine(t, p, g, k) for t, p, g in zip(d["text"], d["page"], d["spiel_id"])]
            yield pa.RecordBatch.from_arrays([pa.array(d["id"], pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string())], names=["id", "stoerungen", "repariert"])

    page = F.coalesce("seite", "seite_pdf").alias("page")
    return chunks.where("id is not null").select("id", "spiel_id", page, "text").mapInArrow(run, "id bigint, stoerungen array<string>, repariert string")


def p1_found(spark, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "chunks")).select("id", F.explode("stoerungen").alias("stoerung"))


def p1_repaired(spark, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "chunks")).where("size(stoerungen) > 0").select("id", "repariert")


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired}
SQL: dict[str, str] = {}

"""Sentences of documents in any language and script.

What a period means is learned without labels, per language, from the documents themselves, by
log-likelihood ratios over all of them: which words are abbreviations (they come with a period far
more often than chance, are short, and are followed by words that do not start sentences), which
pairs over a period belong together, and which words start sentences. Each period is then classified
with these statistics and what follows it. Scripts with their own full stops need no statistics;
Thai, which has none, ends its sentences at blanks. Headings, list entries, blank lines and
quotations are settled by the layout before that.

Counting is one pass and one shuffle of (language, word) sums; what is learned is a small table of
those words that pass a test, of a checked size.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.session import cut, table

#: Scores from which a word counts as abbreviation, as sentence starter, and a pair as belonging together.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
LEAST_SEEN = 3
#: Commonest words of each language that tell what language a text is in.
COMMON_WORDS = 120
#: Rows of a learned table that may travel to the tasks; more are an error, for none may be dropped.
LEARNED_ROWS = 200_000
#: Sums a task holds before it gives them away, and characters of texts whose raw sums it holds before.
HELD_SUMS, HELD_CHARS = 200_000, 4_000_000
#: Words remembered with what is known of them, and the characters up to which a word is.
MEMO_WORDS, MEMO_CHARS = 200_000, 64

#: Sentence ends, closing and opening quotes and brackets, list marks, line ends.
STOPS = ".!?…。！？｡।॥؟۔"
WIDE = "。！？｡।॥"
CLOSE = "\"'”’»“)]}」』）】〉》›"
EDGES = STOPS + CLOSE + ",;:¡¿(（[【„“«「『‘‚–—-*_/·•"
QUOTES = {"„": "“”", "“": "”", "«": "»", "»": "«", "「": "」", "『": "』"}
BRACKETS = {"(": ")", "[": "]", "（": "）", "【": "】"}
STOP_SIGN, STOP_OR_SPACE = re.compile(f"[{STOPS}]"), re.compile(f"[{STOPS}\\s]")
SHIELD = re.compile("[" + re.escape("".join({*QUOTES, *"".join(QUOTES.values()), *BRACKETS, *BRACKETS.values(), '"'})) + "]")
NEWLINE = r"(?:\r\n|\r|\n|\x85| | )"
BLANK = re.compile(NEWLINE + r"[^\S\r\n\x85  ]*" + NEWLINE + r"\s*")
MARK = re.compile(r"\s*(?:[-–—*•·▪◦‣]|\(?\d{1,3}[.)]|\(?[a-zA-Z][)])[^\S\r\n]+(?=\S)")
MARKED_LINE = re.compile(f"{NEWLINE}(?={MARK.pattern})")
#: Combining marks of the scripts that write vowels and tones with them.
MARKS = "\u0300-\u036f\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0962\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"
_WORD = rf"[^\W\d_][\w{MARKS}]*(?:[-'’·.][^\W\d_][\w{MARKS}]*)*|\d+(?:[.,]\d+)*"
TOKEN = re.compile(_WORD)
ALNUM = re.compile(r"[^\W_]")
#: An end sign before whitespace, closing signs or the end.
SIGN = re.compile(r"[.!?](?=[\s\"'”’»“)\]]|$)")
THAI = re.compile(r"[฀-๿]")
WIDE_SCRIPT = re.compile(r"[぀-ヿ㐀-鿿]")
INDIC = re.compile(r"[ऀ-ॿ]")
OTHER_SCRIPT = re.compile(r"[ऀ-ॿ฀-๿぀-ヿ㐀-鿿]")


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the units that layout alone divides: paragraphs, headings and list entries."""
    at = 0
    spans = []
    for m in BLANK.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    for a, b in spans:
        starts = [a]
        inner = [m.end() for m in MARKED_LINE.finditer(text, a, b)]
        # a list may follow its lead-in directly
        if len(inner) > 1 or inner and MARK.match(text, a, b):
            starts += inner
        for s, e in zip(starts, [*starts[1:], b]):
            while e > s and text[e - 1].isspace():
                e -= 1
            while s < e and text[s].isspace():
                s += 1
            if e > s:
                yield s, e


def shielded(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Quotations and brackets of a block, inside which nothing ends."""
    out, stack = [], []
    for m in SHIELD.finditer(text, a, b):
        k, c = m.start(), m.group()
        if stack and c in stack[-1][1]:
            start, _ = stack.pop()
            if not stack:
                out.append((start, k + 1))
        elif c == '"' and not stack:
            # straight quotes open before a letter and close behind one
            if (k == a or text[k - 1].isspace() or text[k - 1] in "(（[") and text.find('"', k + 1, b) > 0:
                stack.append((k, '"'))
        elif c in QUOTES and not (c in "“»" and stack):
            if c not in "“»" or k == a or not text[k - 1].isalnum():
                if any(text.find(e, k + 1, b) > 0 for e in QUOTES[c]):
                    stack.append((k, QUOTES[c]))
        elif c in BRACKETS and text.find(BRACKETS[c], k + 1, b) > 0:
            stack.append((k, BRACKETS[c]))
        k += 1
    return out


class Memo(dict):
    """The languages of which a word, as it stands between blanks, is a common one."""

    def __init__(self, common: dict[str, list[str]]):
        self.common = common

    def __missing__(self, word: str) -> Iterable[str]:
        if len(self) > MEMO_WORDS:
            self.clear()
        known = self[word] = self.common.get(word.strip(EDGES), ())
        return known


class Learned:
    """What the statistics of one run say about words, by language."""

    def __init__(self, rows: Iterable[tuple[str, str, str]]):
        self.kinds: dict[str, set] = defaultdict(set)
        self.common: dict[str, list[str]] = defaultdict(list)
        self.paired: set[tuple[str, str]] = set()
        self.languages = Memo(self.common)
        self.periods: dict[tuple[str, str], tuple | None] = {}
        for kind, lang, word in rows:
            self.kinds[kind].add((lang, word))
            if kind == "common":
                self.common[word].append(lang)
            elif kind == "pair":
                self.paired.add((lang, word.partition(" ")[0]))

    def period(self, text: str, a: int, k: int, lang: str) -> tuple | None:
        """``about`` the word that ends right before the period at ``k``, looked up once for what stands between blanks."""
        s = text.rfind(" ", max(a, k - MEMO_CHARS), k) + 1
        if not s:
            if a < k - MEMO_CHARS:
                return self.about(before(text, a, k), lang)
            s = a
        key = (lang, text[max(s, text.rfind("\n", s, k) + 1) : k])
        try:
            return self.periods[key]
        except KeyError:
            if len(self.periods) > MEMO_WORDS:
                self.periods.clear()
            known = self.periods[key] = self.about(before(key[1], 0, len(key[1])), lang)
            return known

    def about(self, word: str, lang: str) -> tuple | None:
        """(its last part, begins pairs, ordinal, abbreviation or initial, initial, also ends sentences) of a word; None if it is nothing of that."""
        low, short = word.lower(), _parts(word)
        abbreviation = self.has("abbreviation", lang, low) or self.has("abbreviation", lang, short)
        initial = len(word) == 1 and word.isalpha() and (word.isupper() or abbreviation)
        if "." in word and len(word) <= 6 and all(len(p) <= 2 for p in word.split(".")):
            abbreviation = True
        paired = (lang, short) in self.paired
        # ordinals: a number with a period goes on unless a starter follows
        ordinal = word.isdigit() and self.has("ordinal", lang, "#")
        open_ = bool(word) and (abbreviation or initial)
        if not (paired or ordinal or open_):
            return None
        return short, paired, ordinal, open_, initial, self.has("closing", lang, low) or self.has("closing", lang, short)

    def has(self, kind: str, lang: str, word: str) -> bool:
        return (lang, word) in self.kinds[kind]


def before(text: str, a: int, k: int) -> str:
    """The word that ends right before the period at ``k``, with its inner periods."""
    s = k
    while s > a and (text[s - 1].isalnum() or text[s - 1] in ".-'’·" or (ord(text[s - 1]) > 127 and not text[s - 1].isspace() and text[s - 1] not in CLOSE + "„“«「『（–—")):
        s -= 1
    return text[s:k].lstrip(".-'’·")


def _parts(word: str) -> str:
    return word.rsplit("-", 1)[-1].lower()


def ends(text: str, lang: str, learned: Learned) -> list[int]:
    """Offsets just behind each sentence of a text."""
    out: list[int] = []
    m = SHIELD.search(text)
    shield = m.start() if m else len(text)
    for a, b in blocks(text):
        body = a
        m = MARK.match(text, a, b)
        if m:
            body = m.end()
            # one list entry is one sentence
            out.append(b)
            continue
        thai = lang == "th" and bool(THAI.search(text, a, b))
        spans = shielded(text, a, b) if shield < b else ()
        inside = 0
        k = body
        cuts = []
        while k < b:
            m = (STOP_OR_SPACE if thai else STOP_SIGN).search(text, k, b)
            jump = m.start() if m else b
            while inside < len(spans) and spans[inside][1] <= k:
                inside += 1
            if inside < len(spans) and spans[inside][0] <= jump:
                s, e = spans[inside]
                # what is said inside does not end the sentence unless nothing follows that belongs to it
                last = text[e - 2] if e - 2 > s else ""
                if last and last in STOPS:
                    alone = s == (cuts[-1] if cuts else body) or not text[(cuts[-1] if cuts else body) : s].strip()
                    if _quote_ends(text, s, e, b, alone, lang, learned):
                        cuts.append(e)
                k = e
                continue
            k = jump
            if k >= b:
                break
            c = text[k]
            if c in STOPS:
                e = k + 1
                while e < b and (text[e] in STOPS or text[e] in "‼⁉"):
                    e += 1
                f = e
                while f < b and text[f] in CLOSE and not (text[f] in "“«»" and f + 1 < b and text[f + 1].isalnum()):
                    f += 1
                if f >= b or _stops(text, a, b, k, e, f, lang, learned):
                    cuts.append(min(f, b))
                k = f
                continue
            if thai and c.isspace() and _thai_end(text, a, b, k, learned):
                cuts.append(k)
            k += 1
        at = body
        for c in [*cuts, b]:
            while c > at and text[c - 1].isspace():
                c -= 1
            if c > at:
                # signs without words (an emoji behind the period) belong to the sentence before
                if out and out[-1] > a and not ALNUM.search(text, at, c) and not STOP_SIGN.search(text, at, c):
                    out[-1] = c
                else:
                    out.append(c)
            at = max(at, c)
    return out


def _next(text: str, e: int, b: int) -> int:
    while e < b and text[e].isspace():
        e += 1
    return e


def _opens(text: str, n: int, b: int) -> str:
    """The first letter or digit of what follows."""
    while n < b and not text[n].isalnum():
        n += 1
    return text[n] if n < b else ""


def _quote_ends(text: str, s: int, e: int, b: int, alone: bool, lang: str, learned: Learned) -> bool:
    n = _next(text, e, b)
    if n >= b:
        return True
    if text[s] in BRACKETS:
        return alone
    if text[n] in ",;:–—":
        return False
    if text[n] in STOPS:
        return False
    first = text[n]
    if WIDE_SCRIPT.match(first) or INDIC.match(first):
        # a frame follows the quotation directly; the next sentence starts it anew
        return not alone
    if first.isalpha() and first.islower():
        return False
    if not first.isupper() and first.isalpha():
        # no capitals in this script: a frame follows a quotation that opened the sentence
        return not alone
    return True


def _thai_end(text: str, a: int, b: int, k: int, learned: Learned) -> bool:
    n = _next(text, k, b)
    if n >= b or k == a:
        return False
    prev, nxt = text[k - 1], text[n]
    # blanks around numbers and behind an abbreviation's period lie inside a sentence
    if nxt.isdigit() or prev in ".":
        return False
    if prev.isdigit():
        return False
    word = TOKEN.match(text, n)
    if word and text[word.end() : word.end() + 1] == "." and learned.has("abbreviation", "th", word.group()):
        return False
    return bool(THAI.match(prev)) and bool(THAI.match(nxt))


def _stops(text: str, a: int, b: int, k: int, e: int, f: int, lang: str, learned: Learned) -> bool:
    """Whether the signs ``text[k:e]``, closed at ``f``, end a sentence."""
    c = text[k]
    if c in WIDE or c in "؟۔":
        return True
    n = _next(text, f, b)
    if n == f and not (WIDE_SCRIPT.match(text[n]) and c in "!?…"):
        return False
    nxt = text[n]
    first = nxt if nxt.isalnum() else _opens(text, n, b)
    if c != "." or e - k > 1:
        if text[k:e].strip(".") == "" or text[k:e] == "…":
            return bool(first) and not first.islower() and not first.isdigit()
        if c in "!?":
            return not (first.isalpha() and first.islower() and nxt == first)
    if nxt in ",;:)":
        return False
    if nxt == first and first.isalpha() and first.islower() and first != first.upper():
        follow = TOKEN.match(text, n)
        # names may start small (eXpand); a word that starts sentences ends this one
        return bool(follow) and any(x.isupper() for x in follow.group()[1:])
    known = learned.period(text, a, k, lang)
    if known is None:
        return True
    short, paired, ordinal, open_, initial, closing = known
    follow = TOKEN.search(text, n, b)
    after = follow.group().lower() if follow else ""
    if paired and after and learned.has("pair", lang, f"{short} {'#' if after[0].isdigit() else after}"):
        return False
    if ordinal:
        return not after or after[0].isdigit() or learned.has("starter", lang, after)
    if not open_:
        return True
    if closing:
        # abbreviations that also end sentences: what follows decides
        return bool(after) and (learned.has("starter", lang, after) or first.isupper())
    return bool(after) and learned.has("starter", lang, after) and not initial


def llr(a: float, b: float, ab: float, n: float) -> float:
    """Log-likelihood ratio of b following a, signed by the direction."""
    if n <= a or not a or not b:
        return 0.0
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)

    def term(k: float, m: float, q: float) -> float:
        q = min(max(q, 1e-12), 1 - 1e-12)
        return k * math.log(q) + (m - k) * math.log(1 - q)

    value = -2 * (term(ab, a, p) + term(b - ab, n - a, p) - term(ab, a, p1) - term(b - ab, n - a, p2))
    return value if p1 > p else -value


def labelled(text: str, lang: str | None) -> str:
    """The group whose statistics a text adds to: its script where that tells, else its label where that can be one."""
    if OTHER_SCRIPT.search(text):
        for name, pattern in (("th", THAI), ("wide", WIDE_SCRIPT), ("hi", INDIC)):
            if pattern.search(text):
                return name
    code = (lang or "").strip().lower()
    code = code[:2] if re.fullmatch(r"[a-z]{2}([-_].*)?", code) else "-"
    return "-" if code == "xx" else code


def main_language(text: str, lang: str | None, learned: Learned) -> str:
    """The group a text is classified with: that whose common words it has most of, its label on ties."""
    own = labelled(text, lang)
    if own in ("th", "wide", "hi") or not learned.common:
        return own
    # words between blanks, without the signs at their ends
    seen = Counter(chain.from_iterable(map(learned.languages.__getitem__, set(text.lower().split()))))
    return max(seen, key=lambda x: (seen[x], x == own, x)) if seen else own


class Sums:
    """Sums of texts by (kind, language, word, follower): all words, words with a period and what follows it, words at starts.

    A text adds raw sums, of what stands between blanks and of signs with their surroundings; what those
    say about words is worked out once for all that are alike.
    """

    def __init__(self) -> None:
        self.sums: Counter = Counter()
        self.raw: dict[str, tuple[Counter, Counter, Counter]] = defaultdict(lambda: (Counter(), Counter(), Counter()))
        self.chars = 0

    def add(self, text: str, lang: str) -> None:
        pieces, firsts, signs = self.raw[lang]
        # no word goes over a blank
        pieces.update(text.lower().split())
        heads, seen = [], []
        for a, b in blocks(text):
            m = MARK.match(text, a, b)
            first = TOKEN.search(text, m.end() if m else a, b)
            if first:
                heads.append(first.group())
            for m in SIGN.finditer(text, a, b):
                k = m.start()
                s = max(a, k - 39)
                s = max(s, text.rfind(" ", s, k) + 1)
                s = max(s, text.rfind("\n", s, k) + 1)
                follow = TOKEN.search(text, m.end(), b)
                seen.append((text[s : k + 1], follow.group() if follow else ""))
        firsts.update(heads)
        signs.update(seen)
        self.chars += len(text)
        if self.chars > HELD_CHARS:
            self.fold()

    def fold(self) -> None:
        """Raw sums become sums of words."""
        c = self.sums
        for lang, (pieces, firsts, signs) in self.raw.items():
            for x, n in pieces.items():
                for w in TOKEN.findall(x):
                    c["n", lang, "#" if w[0].isdigit() else w, ""] += n
            for w, n in firsts.items():
                c["s", lang, _low(w), ""] += n
            for (x, nxt), n in signs.items():
                words = TOKEN.findall(x, 0, len(x) - 1)
                if not words or not x.endswith(words[-1], 0, len(x) - 1):
                    continue
                if x[-1] != ".":
                    if nxt:
                        c["s", lang, _low(nxt), ""] += n
                    continue
                low = _low(words[-1])
                c["p", lang, low, ""] += n
                if not nxt:
                    c["e", lang, low, ""] += n
                    continue
                c["o", lang, low, _low(nxt)] += n
                if nxt.islower():
                    c["l", lang, low, ""] += n
        self.raw.clear()
        self.chars = 0


def _low(word: str) -> str:
    return "#" if word[0].isdigit() else word.lower()


def bounded(df: DataFrame, what: str, rows: int = LEARNED_ROWS) -> Iterator:
    """The rows of a learned table, one by one; more than ``rows`` are an error."""
    for k, row in enumerate(df.limit(rows + 1).toLocalIterator()):
        if k >= rows:
            raise ValueError(f"more than {rows} {what}: raise sentences.LEARNED_ROWS (and the executors' memory) for this corpus")
        yield row


def learn(df: DataFrame) -> list[tuple[str, str, str]]:
    """(kind, language, word) of what the documents teach, out of (text, lang); counts cover every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sums()

        def flush():
            c = held.sums
            keys = list(c)
            cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(4)]
            out = pa.RecordBatch.from_arrays([*cols, pa.array([c[k] for k in keys], pa.int64())], names=["kind", "lang", "a", "b", "n"])
            c.clear()
            return out

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    held.add(text, labelled(text, lang))
                if len(held.sums) > HELD_SUMS:
                    yield flush()
        held.fold()
        if held.sums:
            yield flush()

    sums = df.select("text", "lang").mapInArrow(run, "kind string, lang string, a string, b string, n bigint")
    sums = cut(sums.groupBy("kind", "lang", "a", "b").agg(F.sum("n").alias("n")))
    word = sums.where("b = ''").groupBy("lang", "a").pivot("kind", ["n", "p", "e", "l", "s"]).agg(F.sum("n")).fillna(0)
    total = {r["lang"]: (r["n"], r["p"], r["s"]) for r in word.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("s").alias("s")).collect()}
    out: list[tuple[str, str, str]] = []
    common = word.where("a <> '#'").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "a"))).where(F.col("r") <= COMMON_WORDS)
    for r in common.where("lang not in ('-', 'th', 'wide', 'hi') and n >= 20").toLocalIterator():
        out.append(("common", r["lang"], r["a"]))
    # only words with a period inside running text can be abbreviations: few, and read one by one
    some = word.where((F.col("p") - F.col("e") >= LEAST_SEEN) & (F.col("p") >= 0.6 * F.col("n")) & (F.col("a") != "#"))
    for r in bounded(some, "words that may be abbreviations"):
        n, p, _ = total[r["lang"]]
        length = len(r["a"].replace(".", "")) + 1
        rest = r["n"] - r["p"]
        ratio = max(llr(r["n"], p, r["p"], n), 0.0)
        score = ratio * math.exp(-length) * (r["a"].count(".") + 1) * (length ** -rest if rest < 50 else 0.0)
        inner = r["p"] - r["e"]
        # a share of followers in lower case proves it for longer words
        lower = rest <= 0.02 * r["n"] and r["l"] >= 0.2 * inner and r["l"] >= LEAST_SEEN
        dotted = "." in r["a"]
        if (score >= ABBREVIATION and (length <= 4 or r["e"] <= 0.3 * r["p"])) or lower or dotted:
            out.append(("abbreviation", r["lang"], r["a"]))
            if r["e"] >= max(2, 0.05 * r["p"]):
                out.append(("closing", r["lang"], r["a"]))
    starts = word.where((F.col("s") >= LEAST_SEEN) & (F.col("s") >= 0.1 * F.col("n")))
    for r in bounded(starts, "words that may start sentences"):
        n, _, s = total[r["lang"]]
        if r["a"] != "#" and llr(s, r["n"], r["s"], n) >= STARTER:
            out.append(("starter", r["lang"], r["a"]))
    # pairs over a period: the follower comes behind this word far more often than elsewhere
    first = {x for x in out if x[0] == "starter"}
    pairs = sums.where((F.col("kind") == "o") & (F.col("n") >= LEAST_SEEN)).select("lang", "a", "b", F.col("n").alias("ab"))
    # ordinals: what follows numbers, by whether it starts sentences
    ordinal: Counter = Counter()
    for r in bounded(pairs.where("a = '#'"), "words behind a number"):
        ordinal[(r["lang"], ("starter", r["lang"], r["b"]) in first)] += r["ab"]
    # of other words only abbreviations can belong to what follows their period; they are a small table
    short = [(x, y) for kind, x, y in out if kind == "abbreviation"]
    if short:
        known = df.sparkSession.createDataFrame(short, "lang string, a string").distinct()
        numbers = word.where("a <> '#'").where(F.col("p") - F.col("e") >= LEAST_SEEN).select("lang", "a")
        follow = pairs.where("a <> '#' and b <> '#'").join(known, ["lang", "a"]).unionByName(pairs.where("a <> '#' and b = '#'").join(numbers, ["lang", "a"]))
        follow = follow.join(word.select("lang", "a", F.col("p").alias("pa"), F.col("e").alias("ea"), F.col("n").alias("na")), ["lang", "a"]).join(word.select("lang", F.col("a").alias("b"), F.col("n").alias("nb")), ["lang", "b"])
        for r in bounded(follow, "pairs over a period"):
            n, _, _ = total[r["lang"]]
            if ("starter", r["lang"], r["b"]) in first or llr(r["pa"], r["nb"], r["ab"], n) < COLLOCATION:
                continue
            # a number belongs to a word only if it follows it mostly; a word must follow beyond chance
            if r["b"] != "#" or r["ab"] >= 0.5 * (r["pa"] - r["ea"]):
                out.append(("pair", r["lang"], f"{r['a']} {r['b']}"))
    for (lang, starter), k in ordinal.items():
        if not starter and k >= LEAST_SEEN and k > 0.2 * ordinal[(lang, True)]:
            out.append(("ordinal", lang, "#"))
    return out


def sentence_ends(df: DataFrame) -> DataFrame:
    """(doc_id, ende) of every sentence of (doc_id, text, lang); statistics are learned from the same documents.

    Null, empty and blank texts have no sentence; a wrong or missing language only costs statistics.
    Offsets are code points of the text as it stands. A repeated row gives its sentences again.
    """
    spark = df.sparkSession
    d = df.select("doc_id", "text", "lang").where("doc_id is not null and text is not null")
    learned = spark.sparkContext.broadcast(learn(d))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Learned(learned.value)
        for batch in batches:
            ids, out = [], []
            for doc, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3))):
                e = ends(text, main_language(text, lang, known), known)
                ids.extend([doc] * len(e))
                out.extend(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int32())], names=["doc_id", "ende"])

    return d.mapInArrow(run, "doc_id bigint, ende int")


def p10_found(spark, sf_dir: str) -> DataFrame:
    return sentence_ends(table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}

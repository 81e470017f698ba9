"""Text decoded with the wrong character encoding: found and restored as a substitution cipher learned per source."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonalis.materialise import discard, materialise, spread

#: Code pages that occur as the true or the assumed encoding of a text.
PAGES = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866")
#: Distinct tokens of a task on average: small sources share one, a large one is dealt over several.
CELL_TOKENS = 20_000
#: Rounds of expectation-maximization; log-odds that a swap must win by; strength of the pooled mapping against a source's own.
ROUNDS, MARGIN, POOL = 3, 6.0, 5.0
#: The same for a token of a single character, which has little context, and where only signs would come out.
ALONE = 12.0
#: Weight of single characters in bigrams.
SHRINK = 5e-5
LOST, WIDE = "�", "一"

_TOKEN = re.compile(r"[^ \t\r\n]+")
_WIDE = re.compile("[⺀-\U0010ffff]")
_CONTROL = re.compile("[\x80-\x9f�]")
#: Texts with such marks don't count for the language statistics (RE2/Java syntax).
MARKED = "[\\x{80}-\\x{9f}\\x{fffd}\\x{2500}-\\x{25a0}]|Ã[^A-ZÀ-Ü\\s.,;:!?'’…]|[ÂÐÑ][\\x{a0}-\\x{bf}€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—™š›œŸ]|â€|[РС][°-¿Ђ-џ]"


def _tables() -> tuple[dict[str, dict[str, int]], dict[str, dict[int, str]]]:
    to_byte, to_char = {}, {}
    for page in PAGES:
        chars = {b: bytes([b]).decode(page, "ignore") for b in range(128, 256)}
        to_char[page] = {b: c for b, c in chars.items() if c}
        to_byte[page] = {c: b for b, c in to_char[page].items()}
    # what a reader of cp1252 does with its undefined bytes, and a reader of latin-1 with 80-9f: the control characters
    to_byte["cp1252"] |= {chr(b): b for b in range(128, 160)}
    return to_byte, to_char


_TO_BYTE, _TO_CHAR = _tables()
#: The byte C3 as pages without Cyrillic letters show it.
_OPEN = ("Ã", "├", "√")
Segments = list[tuple[str, str]]  # (as stored, as meant)


def _single(seg: Segments, read_as: str, truly: str) -> Segments | None:
    """Each character read as ``read_as`` turned into the one its byte means in ``truly``."""
    out = []
    for stored, c in seg:
        if c < "\x80":
            out.append((stored, c))
            continue
        b = _TO_BYTE[read_as].get(c)
        m = None if b is None else _TO_CHAR[truly].get(b)
        if m is None:
            return None
        out.append((stored, m))
    return out


def _utf8(seg: Segments, read_as: str) -> Segments | None:
    """UTF-8 that was read as ``read_as``; a broken sequence becomes LOST. None without one whole sequence."""
    table, out, k, whole = _TO_BYTE[read_as], [], 0, 0
    data = []
    for _, c in seg:
        b = ord(c) if c < "\x80" else table.get(c)
        if b is None:
            return None
        data.append(b)
    while k < len(data):
        b = data[k]
        if b < 0x80:
            out.append(seg[k])
            k += 1
            continue
        n = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        try:
            c = bytes(data[k : k + n]).decode("utf-8") if n and k + n <= len(data) else ""
        except UnicodeDecodeError:
            c = ""
        if len(c) == 1:
            out.append(("".join(s for s, _ in seg[k : k + n]), c))
            whole += 1
            k += n
        elif seg[k][0] in _OPEN and k + 1 == len(data):  # its second byte was A0, a blank to whoever split the text
            out.append((seg[k][0], "à"))
            whole += 1
            k += 1
        else:
            out.append((seg[k][0], LOST))
            k += 1
    return out if whole and sum(m == LOST for _, m in out) <= whole else None


def readings(token: str) -> list[Segments]:
    """The stored reading first, then each other one that some swap of code pages, once or twice, would explain."""
    same: Segments = [(c, c) for c in token]
    found = {token: same}
    for page in PAGES:
        if not all(c < "\x80" or c in _TO_BYTE[page] for c in token):
            continue
        once = _utf8(same, page)
        if once:
            found.setdefault("".join(m for _, m in once), once)
            for again in PAGES:
                twice = _utf8(once, again) if any(m >= "\x80" for _, m in once) else None
                if twice:
                    word = "".join(m for _, m in twice)
                    found.setdefault(word, twice)
                    thrice = _utf8(twice, again)
                    if thrice:
                        found.setdefault("".join(m for _, m in thrice), thrice)
        for truly in PAGES:
            if truly != page:
                one = _single(same, page, truly)
                if one:
                    found.setdefault("".join(m for _, m in one), one)
    return list(found.values())


def _case(c: str) -> str:
    return "u" if c.isupper() or c.istitle() else "l" if c.islower() else "n"


def _script(c: str) -> str:
    """What a character is followed by depends on this where the character itself is rare."""
    if c < "\x80":
        return "a" if c.isalpha() else " " if c.isspace() else "."
    if not c.isalpha():
        return "s"
    return "e" if c < "ɐ" else "g" if c < "Ѐ" else "c" if c < "԰" else "w"


class Language:
    """Letter bigrams without case, times the case of a letter after the case of the one before.

    A bigram falls back on what follows the script of its first character: text stays in its script.
    """

    def __init__(self, pairs: Iterable[tuple[str, str, int]]) -> None:
        two: Counter = Counter()
        case: Counter = Counter()
        for a, b, n in pairs:
            two[a.lower()[:1], b.lower()[:1]] += n
            if _case(b) != "n":
                case[_case(a), _case(b)] += n
        left: Counter = Counter()
        after: Counter = Counter()
        script: Counter = Counter()
        for (a, b), n in two.items():
            left[a] += n
            after[_script(a), b] += n
            script[_script(a)] += n
        total = sum(left.values())
        self.left, self.after, self.script = dict(left), dict(after), dict(script)
        #: Pseudo-counts grow with the corpus: the few bigrams of a wrong encoding stay rare whatever its size.
        self.weight = 5 + SHRINK * total
        self.two = dict(two)
        self.case = {(a, b): math.log((case[a, b] + 0.5) / (case[a, "l"] + case[a, "u"] + 1)) for a in "uln" for b in "ul"}
        self.memo: dict[tuple[str, str], float] = {}

    def pair(self, a: str, b: str) -> float:
        """log P(b after a)."""
        known = self.memo.get((a, b))
        if known is not None:
            return known
        if LOST in (a, b):
            p = -8.0
        else:
            x, y = (WIDE if c >= "⺀" else c.lower()[:1] for c in (a, b))
            n = self.left.get(x, 0)
            s = _script(x)
            back = (self.after.get((s, y), 0) + 0.1) / (self.script.get(s, 0) + 500)
            p = math.log((self.two.get((x, y), 0) + self.weight * back) / (n + self.weight))
            if _case(b) != "n":
                p += self.case[_case(a), _case(b)]
        if len(self.memo) < 500_000:
            self.memo[a, b] = p
        return p

    def word(self, text: str) -> float:
        return sum(map(self.pair, " " + text, text + " "))


class Cipher:
    """What stored symbols stand for: for each source a distribution over letters, on top of one pooled over all sources."""

    def __init__(self, language: Language) -> None:
        self.language = language
        self.own: dict[tuple[str, str, str], float] = {}
        self.own_all: dict[tuple[str, str], float] = {}
        self.pool: dict[tuple[str, str], float] = {}
        self.pool_all: dict[str, float] = {}

    def learn_pool(self, counts: Iterable[tuple[str, str, float]]) -> None:
        """M-step of all sources together: expected counts of (symbol, letter)."""
        pool, pool_all = defaultdict(float), defaultdict(float)
        for symbol, letter, n in counts:
            pool[symbol, letter] += n
            pool_all[symbol] += n
        self.pool, self.pool_all = dict(pool), dict(pool_all)

    def learn_own(self, counts: Iterable[tuple[str, str, str, float]]) -> None:
        """M-step of the sources at hand: expected counts of (source, symbol, letter)."""
        own, own_all = defaultdict(float), defaultdict(float)
        for source, symbol, letter, n in counts:
            own[source, symbol, letter] += n
            own_all[source, symbol] += n
        self.own, self.own_all = dict(own), dict(own_all)

    def learn(self, counts: Iterable[tuple[str, str, str, float]]) -> None:
        counts = list(counts)
        self.learn_own(counts)
        self.learn_pool((symbol, letter, n) for _, symbol, letter, n in counts)

    def log_p(self, source: str, symbol: str, letter: str) -> float:
        whole = (self.pool.get((symbol, letter), 0.0) + 0.05 * (0.5 if symbol == letter or len(symbol) > 1 else 0.02)) / (self.pool_all.get(symbol, 0.0) + 0.05)
        return math.log((self.own.get((source, symbol, letter), 0.0) + POOL * whole) / (self.own_all.get((source, symbol), 0.0) + POOL))

    def score(self, source: str, way: Way) -> float:
        """A swap is one event, so a reading is as likely as its least likely symbol."""
        return way[0] + min((self.log_p(source, s, m) for s, m in way[1]), default=0.0)

    def expect(self, source: str, ways: list[Way], n: float) -> Iterator[tuple[str, str, str, float]]:
        """E-step: the expected counts that a token with these readings, seen ``n`` times, gives."""
        scores = [self.score(source, w) for w in ways]
        top = max(scores)
        weight = [math.exp(s - top) for s in scores]
        total = sum(weight)
        clusters = {s for w in ways[1:] for s, _ in w[1] if len(s) > 1}
        for k, (way, w) in enumerate(zip(ways, weight)):
            share = n * w / total
            if share < 1e-3:
                continue
            for s, m in way[1]:
                yield source, s, m, share
                if len(s) > 1:  # its characters don't stand for themselves here
                    for c in s:
                        yield source, c, "", share
            if k == 0:
                for s in clusters:  # as many chances to be a cipher symbol that it didn't take
                    yield source, s, s, share

    def decide(self, source: str, token: str, ways: list[Way] | None = None) -> tuple[bool, str, int]:
        """(garbled?, restored token, characters lost beyond repair)."""
        if token.isascii():
            return False, token, 0
        ways = weighed(token, self.language) if ways is None else ways
        scores = [self.score(source, w) for w in ways]
        best = max(range(len(ways)), key=scores.__getitem__)
        damaged = bool(_CONTROL.search(token))
        if not best:
            return damaged, token, token.count(LOST)
        way = readings(token)[best]
        letters = any(s != m and m.isalpha() for s, m in way)
        need = MARGIN if letters and (len(token) > 1 or token in _OPEN) or any(len(s) > 1 for s, _ in way) else ALONE
        if scores[best] - scores[0] > need or damaged:
            # a single-byte swap is a substitution of characters; in the others a symbol has several
            word = token.translate({ord(s): m for s, m in way}) if all(len(s) == 1 for s, _ in way) else "".join(m for _, m in way)
            return True, word, word.count(LOST)
        return damaged, token, token.count(LOST)


Way = tuple[float, list[tuple[str, str]]]  # (log-likelihood as language, the symbols outside ASCII with what they mean) of a reading


def weighed(token: str, language: Language) -> list[Way]:
    """The readings of a token, each with what the language makes of it: computed once, whatever the rounds."""
    return [(language.word("".join(m for _, m in seg)), [(s, m) for s, m in seg if s >= "\x80"]) for seg in readings(token)]


def _count_pairs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n: Counter = Counter()
        for token, k in zip(batch["token"], batch["clean"].tolist()):
            text = f" {_WIDE.sub(WIDE, token)} "
            for pair in zip(text, text[1:]):
                n[pair] += k
        yield pd.DataFrame([(ord(a), ord(b), c) for (a, b), c in n.items()], columns=["a", "b", "n"])


def _weigh(batches: Iterable[pd.DataFrame], language: Language) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(ways=[pickle.dumps(weighed(t, language), protocol=5) for t in batch["token"]])


def _tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """The tokens of each document, split where blanks are."""
    return docs.select(*keep, F.explode(F.split("text", "[ \t\r\n]+")).alias("token")).filter("token <> ''")


def _outside_ascii(column: str) -> Column:
    return F.length(column) < F.octet_length(column)


class Learned:
    """The ciphers of all sources as tables: the weighed tokens in cells, and what each source's symbols stand for."""

    def __init__(self, docs: DataFrame) -> None:
        """``docs``: text and source (not null). Language bigrams come from the documents without a plain mark of damage."""
        spark = docs.sparkSession
        marked = docs.withColumn("clean", (~F.col("text").rlike(MARKED)).cast("int"))
        counted = materialise(_tokens(marked, "source", "clean").groupBy("source", "token").agg(F.count("*").alias("n"), F.sum("clean").alias("clean")), "tokens")
        pairs = spread(counted.filter("clean > 0").select("token", "clean"), "token").mapInPandas(_count_pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        self.cipher = Cipher(Language([(chr(r.a), chr(r.b), r.n) for r in pairs.collect()]))
        odd = counted.filter(_outside_ascii("token")).select("source", "token", "n")
        cells = max(1, math.ceil(odd.count() / CELL_TOKENS))
        # a source with more than a task's tokens is dealt over several: at most as many rows as there are cells
        self.parts = materialise(odd.groupBy("source").agg(F.ceil(F.count("*") / CELL_TOKENS).cast("int").alias("parts")).filter("parts > 1"), "parts")
        self.cell = F.pmod(F.xxhash64("source"), F.lit(cells)).cast("int")
        dealt = odd.join(self.parts, "source", "left").select("source", "token", "n", self.cell.alias("cell"), F.coalesce(F.pmod(F.xxhash64("token"), F.col("parts")).cast("int"), F.lit(0)).alias("part"))
        language = spark.sparkContext.broadcast(self.cipher.language)
        self.work = materialise(spread(dealt, "token").mapInPandas(lambda it: _weigh(it, language.value), "source string, token string, n long, cell int, part int, ways binary"), "ways")
        discard(counted)
        self.own = materialise(spark.createDataFrame([], "source string, symbol string, letter string, n double"), "own")
        for _ in range(ROUNDS):
            self._round()

    def _asked(self, run: Callable[[Cipher, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """``run`` over the tokens of each cell, with the cipher of the sources in it."""
        pool = self.work.sparkSession.sparkContext.broadcast(self.cipher)
        own = self.own.join(self.parts, "source", "left").select("source", "symbol", "letter", "n", self.cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        empty = [f.split()[0] for f in schema.split(", ")]

        def cell(tokens: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if not len(tokens):
                return pd.DataFrame([], columns=empty)
            cipher = pool.value
            cipher.learn_own(known[["source", "symbol", "letter", "n"]].itertuples(index=False, name=None))
            return run(cipher, tokens)

        return self.work.groupBy("cell", "part").cogroup(own.groupBy("cell", "part")).applyInPandas(cell, schema)

    def _round(self) -> None:
        """One round of expectation-maximization. The driver gets the pooled counts: their number depends on the alphabet (scripts above
        U+2E80 count as one letter), not on the number of documents or sources."""

        def expected(cipher: Cipher, tokens: pd.DataFrame) -> pd.DataFrame:
            sums: dict[tuple[str, str, str], float] = defaultdict(float)
            for source, ways, n in zip(tokens["source"], tokens["ways"], tokens["n"].tolist()):
                for c, s, m, e in cipher.expect(source, pickle.loads(ways), n):
                    sums[c, s, m] += e
            return pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["source", "symbol", "letter", "n"])

        new = materialise(self._asked(expected, "source string, symbol string, letter string, n double").groupBy("source", "symbol", "letter").agg(F.sum("n").alias("n")), "own")
        discard(self.own)
        self.own = new
        self.cipher.learn_pool((r.symbol, r.letter, r.n) for r in new.groupBy("symbol", "letter").agg(F.sum("n").alias("n")).collect())

    def decisions(self) -> DataFrame:
        """(source, token, word, lost, strong): the garbled tokens of each source. A single character proves nothing by itself: it is
        restored only beside other garbled words."""

        def decided(cipher: Cipher, tokens: pd.DataFrame) -> pd.DataFrame:
            out = []
            for source, token, ways in zip(tokens["source"], tokens["token"], tokens["ways"]):
                bad, word, lost = cipher.decide(source, token, pickle.loads(ways))
                if bad:
                    out.append((source, token, word, lost, len(token) > 1 or token in _OPEN or bool(_CONTROL.match(token))))
            return pd.DataFrame(out, columns=["source", "token", "word", "lost", "strong"])

        return self._asked(decided, "source string, token string, word string, lost int, strong boolean")

    def close(self) -> None:
        for table in (self.work, self.own, self.parts):
            discard(table)


def _substitute(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc, text, words in zip(batch["doc"].tolist(), batch["text"], batch["words"]):
            swap = {w["token"]: w["word"] for w in words}
            out.append((doc, _TOKEN.sub(lambda m: swap.get(m.group(), m.group()), text), sum(w["strong"] for w in words), sum(w["lost"] for w in words)))
        yield pd.DataFrame(out, columns=["doc", "texto", "palabras", "perdidos"])


def restore(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, texto, palabras, perdidos): the garbled documents with their text restored, the number of different garbled
    words, and of characters that can't be restored (U+FFFD in ``texto``).

    A token with a character outside ASCII may have been read with the wrong code page, once or several times. Its readings under
    all swaps of PAGES are the keys of a substitution cipher; EM learns per source which symbol stands for which letter,
    against the bigrams of the corpus; the stored reading is one of the keys and wins unless another one is better by MARGIN.

    Defined cases: null and empty texts, and texts in ASCII, are never garbled; a null source is a source of its own; a doc_id
    on several rows gives one row each time its text is garbled, exact repeats count once; an empty table gives an empty
    result; further columns are ignored.

    Plan: one pass over the texts counts tokens per source, all else runs over distinct tokens: each is weighed once, the rounds
    meet it with its own source's cipher in cells of bounded size, so a hot source costs no more than its vocabulary, and every
    source has its own cipher however many there are. The garbled tokens join back to the documents as a table; only
    documents that hold one reach Python.
    """
    docs = documents.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source"))
    learned = Learned(docs.select("text", "source"))
    bad = materialise(learned.decisions(), "garbled")
    learned.close()
    odd = docs.filter(_outside_ascii("text")).withColumn("mark", F.xxhash64("text"))
    held = _tokens(odd, "doc", "mark", "source").filter(_outside_ascii("token")).join(bad, ["source", "token"])
    # a word counts once, however often the document holds it
    held = held.groupBy("doc", "mark").agg(F.collect_set(F.struct("token", "word", "lost", "strong")).alias("words")).filter(F.exists("words", lambda w: w["strong"]))
    kind = dict(docs.dtypes)["doc"]
    found = odd.select("doc", "mark", "text").join(held, ["doc", "mark"]).select("doc", "text", "words")
    return found.mapInPandas(_substitute, f"doc {kind}, texto string, palabras int, perdidos int").distinct().withColumnRenamed("doc", doc_id)

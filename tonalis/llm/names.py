"""Spellings of names typed by people, linked when they mean the same artist."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection, Iterable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.materialise import discard, materialise, spread, task_count
from tonalis.operators.components import connected_components

#: Least Jaro-Winkler similarity of two core names, and of a mistyped known word to the word.
CORE_JW, WORD_JW = 0.90, 0.87
#: Below CORE_JW two core names still agree from this similarity on if slips of typing explain the difference: the cost of the
#: slips at most, by the length of the shorter name. A pair that costs more than SURE counts only as the nearest of one of its ends.
TYPED_JW, TYPED_COST, SURE = 0.70, {5: 0.8, 6: 1.3, 7: 1.7}, 1.0
#: A word is common if it stands beside this many different rarer words; it is an addition if it follows the rare word in this share
#: of its names, or if this share of its names also occurs without it.
COMPANIONS, TRAILING, SPARED = 10, 0.8, 0.5
#: A word that all but never makes a difference is an addition beside this many rarer words already, from this share.
FEW, NEARLY_ALL = 4, 0.9
#: A word near a known one is a mistyped form of it, and no word of its own, up to this share of the known one's names.
MISTYPED = 0.05
#: Longest core whose forms less two letters are block keys; longest code whose forms less one sound are (halves beyond).
TYPED_LENGTH, CODE_LENGTH = 24, 32
#: Cores longer than this agree by two edits at most, whatever their similarity.
LONG_CORE = 64

# Given names with their familiar forms.
NICKNAMES = {
    "alejandro": ("alex", "ale", "jandro", "jano"), "angela": ("angie", "angelita"), "beatriz": ("bea", "beti"), "catherine": ("cate", "cathy", "cat"),
    "concepcion": ("concha", "conchi", "conchita"), "dolores": ("lola", "loli", "lolita"), "eduardo": ("edu", "lalo", "eddy"),
    "ekaterina": ("katia", "katya", "katiusha"), "elizabeth": ("betty", "beth", "liz", "eliza", "lisa"), "enrique": ("kike", "quique"),
    "francisco": ("paco", "pancho", "fran", "kiko", "curro"), "friedrich": ("fritz", "fred"), "gabriela": ("gabi", "gaby"), "gerard": ("gege", "gerry"),
    "guadalupe": ("lupe", "lupita"), "hernan": ("nano",), "ignacio": ("nacho",), "isabel": ("chabela", "isa", "chavela"), "jesus": ("chuy", "chus"),
    "joao": ("joca", "joaozinho"), "jose": ("pepe", "pepito"), "katherine": ("kate", "kathy", "katy"), "leonardo": ("leo", "nardo"), "luis": ("lula", "lucho", "luisito"),
    "manuel": ("manolo", "manu", "lolo", "nano"), "margaret": ("peggy", "maggie", "meg", "marge"), "maria": ("ma", "mari", "maruja", "mary"),
    "natalia": ("nata", "nati", "natasha"), "nikolai": ("kolia", "kolya", "nico"), "oswaldo": ("wally", "waldo", "osvaldo", "valdo"),
    "patricia": ("paty", "patri", "pati"), "robert": ("bob", "bobby", "rob", "robbie"), "roberto": ("beto", "tito"), "santiago": ("chago", "santi", "yago"),
    "teresa": ("tere", "teresita"), "theodore": ("ted", "theo", "teddy"), "ursula": ("uxi", "uschi", "ursi"), "valentina": ("vale", "valen", "tina"),
    "william": ("bill", "will", "billy", "wally", "willy"), "xavier": ("javi", "xavi", "javier"), "yolanda": ("yoli", "yola"), "zacarias": ("zaca", "zac"),
}
# Words for kinds of performers with their short forms; articles; marks of channels. Other additions are learned.
KINDS = {
    "banda": ("bda",), "conjunto": ("conj", "cjto", "cto"), "coro": (), "grupo": ("gpo", "grup", "gr"), "hermanos": ("hnos", "hnas", "hermanas"),
    "orquesta": ("orq", "orkesta"), "trio": ("3o",), "dj": ("deejay",), "mc": ("emcee",), "don": ("dn",), "lady": ("leidy",),
}
ARTICLES = ("the", "los", "las", "el", "la", "l", "lo")
ADDED = ("oficial", "official", "topic")
CONNECTORS = ("y", "e", "i", "and", "con", "with", "et", "und", "&")
NO_ONE = ("variosartistas", "variousartists", "varios", "various", "vvaa", "vva", "va", "unknown", "unknownartist", "artistadesconocido", "desconocido", "desconocida", "anonimo", "anonymous", "interpretesvarios", "sinartista", "sinnombre", "nn", "na", "none", "null")

_WORDS: dict[str, frozenset[str]] = {}
for _table in (NICKNAMES, KINDS):
    for _full, _short in _table.items():
        for _w in (_full, *_short):
            _WORDS[_w] = _WORDS.get(_w, frozenset()) | {_full}
_KINDS, _ARTICLES, _ADDED, _LINKS, _NO_ONE = set(KINDS), set(ARTICLES), set(ADDED), set(CONNECTORS), set(NO_ONE)
_LONG = sorted((w for w in [*NICKNAMES, *KINDS] if len(w) >= 4), key=len, reverse=True)
_QUOTED = re.compile(r"[«“\"„‘‚‹](.*?)[»”\"“’‘›]")
_PIECE = re.compile(r"[^\W_]+\.?|[&,()]")


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a bonus of a tenth for each of up to four equal first characters."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(la, lb) // 2 - 1
    used, left = [False] * lb, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    same = 0
    while same < min(4, la, lb) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn ``a`` into ``b``."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, last[j - 2] + 1)
            row.append(best)
    return row[-1]


# The rows of the Latin keyboard.
KEYBOARD = ("qwertyuiop", "asdfghjklñ", "zxcvbnm")
_AT = {c: (row, place + row / 4) for row, keys in enumerate(KEYBOARD) for place, c in enumerate(keys)}


def slip(x: str, y: str) -> float:
    """Cost of one letter typed for another: half for neighbours on the keyboard and letters of the same sound."""
    if x in _AT and y in _AT:
        (r, i), (s, j) = _AT[x], _AT[y]
        if abs(r - s) <= 1 and abs(i - j) <= 1:
            return 0.5
    return 0.5 if x.translate(_SOUND) == y.translate(_SOUND) or {x, y} == {"i", "y"} else 1.2


def typing_cost(a: str, b: str) -> float:
    """The cheapest slips that turn ``a`` into ``b``: swaps of neighbours and repeated letters cost half, lost and added letters 0.8."""
    lone = lambda s, k: 0.5 if k and s[k] == s[k - 1] else 0.8
    before, row = [], [0.0]
    for j in range(len(b)):
        row.append(row[-1] + lone(b, j))
    for i, x in enumerate(a):
        last, before, row = before, row, [row[0] + lone(a, i)]
        for j, y in enumerate(b):
            best = min(before[j + 1] + lone(a, i), row[j] + lone(b, j), before[j] + (0 if x == y else slip(x, y)))
            if i and j and x == b[j - 1] and a[i - 1] == y and x != y:
                best = min(best, last[j - 1] + 0.5)
            row.append(best)
    return row[-1]


_SOUND = str.maketrans({**dict.fromkeys("bvw", "b"), **dict.fromkeys("ckq", "k"), **dict.fromkeys("szx", "s"), **dict.fromkeys("gjh", "j"), **dict.fromkeys("dt", "t"), **dict.fromkeys("mn", "n"), **dict.fromkeys("pf", "p")})


def sound(word: str) -> str:
    """Phonetic code: classes of consonants that are taken for each other, without vowels and repetitions."""
    out = ""
    for c in word.translate(_SOUND):
        if c not in "aeiouy" and c != out[-1:]:
            out += c
    return out or word[:1]


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


_near: dict[str, str] = {}


def _less(word: str, most: int) -> set[str]:
    """The word, and what is left of it without one letter, or without two."""
    return {"".join(c for k, c in enumerate(word) if k not in gone) for n in range(most + 1) for gone in combinations(range(len(word)), n)}


#: The known words by what is left of them without two letters: two words within two edits share one of these.
_LEFT: dict[str, set[str]] = {}
for _w in _WORDS:
    for _left in _less(_w, 2) if len(_w) > 3 else ():
        _LEFT.setdefault(_left, set()).add(_w)
_LONGEST = max(map(len, _WORDS))


def nearest_words(token: str) -> str:
    """What the token may be a mistyped form of: all that the nearest known words stand for, joined by ``|``; empty if none is near.

    Another ending is another name, as in Mario and María.
    """
    if token not in _near:
        if len(_near) > 200_000:
            _near.clear()
        off = {}
        for w in set().union(*(_LEFT.get(left, ()) for left in _less(token, 2))) if len(token) <= _LONGEST + 2 else ():
            if jaro_winkler(token, w) >= 0.75:
                n = edits(token, w)
                short, long = sorted((token, w), key=len)
                ending = n == 1 and (token[:-1] == w[:-1] and {token[-1], w[-1]} <= set("aeo") or long[:-1] == short and long[-1] in "aeo" and long[-1] != short[-1])
                if not ending and (n <= 1 or n == 2 and jaro_winkler(token, w) >= WORD_JW):
                    off[w] = n
        best = min(off.values(), default=0)
        _near[token] = "|".join(sorted({full for w, n in off.items() if n == best for full in _WORDS[w]}))
    return _near[token]


def split_name(name: str) -> list[tuple[str, bool]] | None:
    """The words of a spelling, each with whether it stands in brackets, what follows a comma first; None for what names no one."""
    text = fold(re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])", " ", name) if not re.search(r"[\s_\-]", name.strip()) else name)
    if re.sub(r"[\W_]", "", text) in _NO_ONE or not re.search(r"[^\W_]", text):
        return None
    text = re.sub(r"[+/]", " & ", re.sub(r"[&+]\s*co\b\.?", " co ", re.sub(r"[_\-‐–—]", " ", _QUOTED.sub(" ", text) if _QUOTED.sub("", text).strip(" _-") else text)))
    pieces = _PIECE.findall(re.sub(r"['’´`]", " ", text))
    if "," in pieces:
        at = pieces.index(",")
        pieces = pieces[at + 1 :] + pieces[:at]
    inside, flat = False, []  # (word, in brackets)
    for p in pieces:
        if p in "()":
            inside = p == "("
        elif p != ",":
            flat.append((p, inside))
    words = []
    for k, (p, b) in enumerate(flat):
        bare = p.rstrip(".")
        if len(bare) == 1 and bare.isalpha() and bare.isascii() and (p.endswith(".") or bare not in _LINKS | _ARTICLES or k in (0, len(flat) - 1) and bare not in _ARTICLES):
            words.append((bare + ".", b))
        else:
            words.append((bare, b))
    if len(words) == 1 and words[0][0] not in _WORDS:
        for w in _LONG:
            if words[0][0].startswith(w) and len(words[0][0]) - len(w) >= 4:
                words = [(w, False), (words[0][0][len(w) :], False)]
                break
    return words


def parse(name: str, known: Collection[str] = (), additions: Collection[str] = ()) -> tuple[str, list[str], bool] | None:
    """(core name, heads, whether two persons) of a spelling; None for what names no one.

    The core is the word that is no given name, kind, article or addition. Heads are given names or kinds in full (alternatives
    joined by ``|``), ``@`` for an article alone, or an initial with a full stop; duos have theirs sorted. ``known`` and ``additions`` are
    the words of the name that the corpus shows to be heads and additions.
    """
    words = split_name(name)
    if words is None:
        return None
    duo = False
    heads: list[str] = []
    places: list[int] = []  # of the heads
    rest: list[str] = []
    article = False
    added: list[str] = []
    bracket: list[str] = []
    for k, (w, b) in enumerate(words):
        if w in _LINKS:
            duo |= 0 < k < len(words) - 1
        elif w.endswith(".") or w in known and w not in _ARTICLES and w not in _WORDS and w not in additions:
            heads.append(w)
            places.append(k)
        elif w in _ARTICLES:
            article = True
        elif w in _ADDED or w not in _WORDS and w in additions:
            added.append(w)
        elif w in _WORDS:
            (bracket if b else heads).append("|".join(sorted(_WORDS[w])))
            if not b:
                places.append(k)
        else:
            rest.append(w)
    if len(rest) > 1:
        for near, w in [(nearest_words(w), w) for w in rest]:
            if near and len(rest) > 1:
                rest.remove(w)
                at = next(k for k, (x, _) in enumerate(words) if x == w)
                where = sum(k < at for k in places)
                heads.insert(where, near)
                places.insert(where, at)
    heads = heads or ([] if article else bracket)  # "(grupo)" after a name that has its kind is an addition
    if not rest:  # every word is a known one: the last is the name
        full = [h for h in heads if not h.endswith(".")]
        if full:
            rest = [full[-1]]
            heads.remove(full[-1])
        elif added:
            rest = added[:1]
        else:
            rest, heads = ["".join(w for w, _ in words)], []
    core = rest[-1]
    heads += [w for w in dict.fromkeys(rest[:-1]) if w not in heads and w != core]
    if not duo and heads[:2] in (["m.", "c."], ["d.", "j."]):
        heads[:2] = [heads[0][0] + heads[1][0]]
    kinds = [h for h in heads if h in _KINDS]
    if kinds and len(heads) > 1 and not duo:
        heads = kinds[:1]
    duo = duo and len(heads) > 1
    if duo:
        heads = sorted(heads)
    if article and not heads:
        heads = ["@"]
    return core, heads, duo


def _tokens(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        split = [(n, split_name(n)) for n in batch["nombre"]]
        rows = [(n, [w for w, _ in words if not w.endswith(".")], not any(w.endswith(".") for w, _ in words)) for n, words in split if words]
        yield pd.DataFrame(rows, columns=["nombre", "words", "whole"])


def _kin(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each word the known words that it is a form of, or mistyped."""
    for batch in batches:
        rows = [(w, n, full, w in _WORDS) for w, n in zip(batch["word"], batch["n"]) for full in (_WORDS.get(w) or nearest_words(w).split("|")) if full]
        yield pd.DataFrame(rows, columns=["word", "n", "full", "known"])


def _mistyped(often: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written table that it reads, and (word): the words near a known one that are much rarer than it, counted in names with all its forms."""
    kin = materialise(often.mapInPandas(_kin, "word string, n long, full string, known boolean"), "kin")
    family = kin.filter("known").groupBy("full").agg(F.sum("n").alias("family"))
    return kin, kin.filter("not known").join(family, "full").filter(F.col("n") <= MISTYPED * F.col("family")).select("word").distinct()


def learn_words(names: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(nombre, known, additions), and the written tables that it reads: the words of each name that the whole collection shows to be common, by what they are.

    A word's names are looked at from their rarest word (the last one of several). A word beside COMPANIONS different rarer
    words is common. It is an addition if it mostly follows the rare word, or if most of its names also occur
    without it; else it is a head, as given names are. A mistyped known word is left out: in a large collection the same slip
    stands beside many words, and would else become a head of its own. Nothing is typed in, and what is learned joins back by
    name: no list is collected or sent.
    """
    split = materialise(names.mapInPandas(_tokens, "nombre string, words array<string>, whole boolean"), "words")
    at = split.select("nombre", F.posexplode("words").alias("at", "word"), F.array_distinct("words").alias("bag"))
    often = materialise(at.select("nombre", "word").distinct().groupBy("word").agg(F.count("*").alias("n")), "often")
    kin, slips = _mistyped(spread(often, "word"))
    often_known = often.join(slips, "word", "left_anti")
    seen = at.join(often_known, "word").groupBy("nombre").agg(F.min(F.struct("n", (-F.col("at")).alias("at"), "word")).alias("rare"), F.collect_list(F.struct("word", "at", "n")).alias("all"), F.first("bag").alias("bag"))
    key = lambda a: F.xxhash64(F.array_join(F.array_sort(a), " "))
    beside = seen.select("nombre", "rare", "bag", F.explode("all").alias("w")).filter("w.n > rare.n")
    beside = beside.select("nombre", F.col("w.word").alias("word"), F.col("rare.word").alias("rare"), (F.col("w.at") > -F.col("rare.at")).cast("int").alias("after"), key(F.array_remove("bag", F.col("w.word"))).alias("less"))
    whole = split.filter("whole").select(key(F.array_distinct("words")).alias("less"), F.lit(1).alias("spared")).distinct()
    per = beside.join(whole, "less", "left").groupBy("word", "rare").agg(F.count("*").alias("n"), F.sum("after").alias("after"), F.sum(F.coalesce("spared", F.lit(0))).alias("spared"))
    stats = per.groupBy("word").agg(F.count("*").alias("beside"), (F.sum("after") / F.sum("n")).alias("after"), (F.sum("spared") / F.sum("n")).alias("spared"))
    common = materialise(stats.filter((F.col("beside") >= COMPANIONS) | (F.col("beside") >= FEW) & (F.col("spared") >= NEARLY_ALL)).select("word", ((F.col("after") >= TRAILING) | (F.col("spared") >= SPARED)).alias("addition")), "common")
    by = beside.select("nombre", "word").distinct().join(common, "word").groupBy("nombre").agg(F.collect_list(F.when(~F.col("addition"), F.col("word"))).alias("known"), F.collect_list(F.when(F.col("addition"), F.col("word"))).alias("additions"))
    return by, [split, often, kin, common]


def _sound_keys(core: str) -> set[str]:
    """The phonetic code and what is left of it without one sound; of a very long code its halves, of which one slip leaves one whole."""
    code = sound(core)
    if len(code) > CODE_LENGTH:
        half = len(code) // 2
        return {code, f"{code[:half]}<", f">{code[-half:]}"}
    return _less(code, 1) if len(code) > 2 else {code}


def _parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for name, heads_known, additions in zip(batch["nombre"], batch["known"], batch["additions"]):
            p = parse(name, () if heads_known is None else set(heads_known), () if additions is None else set(additions))
            if p:
                core, heads, duo = p
                initials = any(h.endswith(".") or "|" in h for h in heads)  # may stand for several names
                lead = " ".join(heads) if initials else " ".join(sorted(heads)[:1]) if duo else " ".join(heads[:1])
                known = lead if lead in _WORDS or initials or lead in ("", "@") else sound(lead)
                keys = [f"{known}/{c}" for c in sorted(_sound_keys(core))]
                if min(TYPED_COST) <= len(core) <= TYPED_LENGTH:  # two slips of typing may change every sound
                    keys += [f"{known}~{c}" for c in sorted(_less(core, 2 if len(core) > 5 else 1))]
                if heads and not initials and "@" not in heads:  # the same words in another order, whichever of them is the core
                    keys.append("#" + " ".join(sorted(map(sound, [core, *heads]))))
                out.append((name, core, " ".join(heads), duo, initials, keys, re.sub(r"[\W_]", "", fold(name))))
        yield pd.DataFrame(out, columns=["nombre", "core", "heads", "duo", "initials", "keys", "glued"])


def _same(heads_a: str, heads_b: str) -> bool:
    """Whether two lists of heads of equal kind can be one artist's; a missing middle name is left to the unique owner."""
    a, b = heads_a.split(), heads_b.split()
    return len(a) == len(b) and all(x == y or not {x, y} & _WORDS.keys() and x[-1] != "." and y[-1] != "." and jaro_winkler(x, y) >= WORD_JW for x, y in zip(a, b))


def _reordered(core_a: str, heads_a: str, core_b: str, heads_b: str) -> bool:
    """Whether two forms have the same words in another order: the core of one is a head of the other. A known word is not mistyped."""
    a, b = (sorted([core, *heads.split()], key=lambda w: (sound(w), w)) for core, heads in ((core_a, heads_a), (core_b, heads_b)))
    alike = lambda x, y: x == y or not {x, y} & _WORDS.keys() and edits(x, y) <= 1 and jaro_winkler(x, y) >= CORE_JW
    if len(a) != len(b) or not any(alike(core_a, h) for h in heads_b.split()):
        return False
    return all(map(alike, a, b))


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether at most so many insertions, deletions and substitutions turn ``a`` into ``b``: a band along the diagonal, so the time grows with the length and not with its square."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        last, row = row, {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = last.get(j, most) + 1
            if j:
                best = min(best, row.get(j - 1, most) + 1, last.get(j - 1, most) + (x != b[j - 1]))
            row[j] = best
        if min(row.values()) > most:
            return False
    return row.get(len(b), most + 1) <= most


def core_cost(a: str, b: str) -> float | None:
    """What the difference of two core names costs in slips of typing, or None if they are different names."""
    if a == b:
        return 0.0
    if max(len(a), len(b)) > LONG_CORE:
        return SURE if within_edits(a, b, 2) else None
    cost, near, short = typing_cost(a, b), jaro_winkler(a, b), min(len(a), len(b))
    allowed = 2 if short > 7 or sound(a) == sound(b) and short > 4 else 1
    if near >= CORE_JW and edits(a, b) <= allowed:
        return min(cost, SURE)
    return cost if near >= TYPED_JW and cost <= TYPED_COST.get(min(short, max(TYPED_COST)), 0.0) else None


def _accept(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for a, b, ca, ha, cb, hb in zip(batch["a"], batch["b"], batch["core_a"], batch["heads_a"], batch["core_b"], batch["heads_b"]):
            cost = core_cost(ca, cb) if _same(ha, hb) else None
            if cost is not None and cost > SURE and "." in ha:
                cost = None  # an initial says too little to make up for another core
            if cost is None and _reordered(ca, ha, cb, hb):
                cost = 0.0
            if cost is not None:
                out.append((a, b, cost))
        yield pd.DataFrame(out, columns=["a", "b", "cost"]).astype({"a": "int64", "b": "int64", "cost": "float64"})


def _nearest(accepted: DataFrame) -> DataFrame:
    """(a, b): the sure links, and of the others those to the nearest form of one of their ends."""
    sure = accepted.filter(F.col("cost") <= SURE)
    rest = accepted.filter(F.col("cost") > SURE)
    best = accepted.select(F.explode(F.array("a", "b")).alias("n"), "cost").groupBy("n").agg(F.min("cost").alias("best"))
    near = [rest.join(best.withColumnRenamed("n", end), end).filter("cost = best").select("a", "b") for end in "ab"]
    return sure.select("a", "b").unionByName(near[0]).unionByName(near[1]).distinct()


def link_spellings(spellings: DataFrame, column: str = "nombre") -> DataFrame:
    """(nombre, entidad): each distinct spelling that names someone, with the number of the artist it means.

    Spellings with the same core name and heads are one form. Forms that share a block - the phonetic code of the head and that
    of the core, or the latter less one sound, or the core less two letters - are linked if the cores agree by Jaro-Winkler, or by a
    lower one and slips of typing, and the heads by the nickname table. Forms that share the sorted phonetic codes of all their
    words are linked if they have the same words in another order. Connected components give the artists. A form with less
    (an initial, no middle name, no head at all) is then compared with the artists whose heads it abbreviates and linked if all
    artists that it could mean have the same head; connected components of these links give the result. Common words that
    no table has are learned from the whole collection (:func:`learn_words`).

    Defined cases: null, empty and blank names and the labels for various or unknown artists name no one and are left out; exact
    repeats count once; names without letters of any script are left out, others are compared as they are; an empty table
    gives an empty result; further columns are ignored.

    Plan: distinct spellings are parsed once; only distinct forms are joined by block, the cheap bound on the edit distance
    runs inside the join; abbreviations meet one row per key (min and max of the owners) or per key, core and head, never all pairs.
    """
    names = materialise(spellings.select(F.col(column).alias("nombre")).filter(F.col("nombre").isNotNull()).distinct(), "names")
    learned, made = learn_words(spread(names, "nombre"))
    parsed = materialise(names.join(learned, "nombre", "left").repartition(task_count(names.sparkSession), "nombre").mapInPandas(_parse, "nombre string, core string, heads string, duo boolean, initials boolean, keys array<string>, glued string"), "parsed")
    by_form = ["core", "heads", "duo"]
    forms = materialise(parsed.groupBy(*by_form).agg(F.first("initials").alias("initials"), F.first("keys").alias("keys")).withColumn("form", F.xxhash64(*by_form)), "forms")
    block = forms.select("form", "core", "heads", "duo", F.explode("keys").alias("key"))
    a, b = (block.select(F.col("key"), F.col("duo"), *[F.col(c).alias(f"{c}_{s}") for c in ("form", "core", "heads")]) for s in "ab")
    pairs = a.join(b, ["key", "duo"]).filter((F.col("form_a") < F.col("form_b")) & (F.col("key").startswith("#") | (F.levenshtein("core_a", "core_b", 4) >= 0))).select(F.col("form_a").alias("a"), F.col("form_b").alias("b"), "core_a", "heads_a", "core_b", "heads_b").distinct()
    accepted = materialise(pairs.repartition(task_count(names.sparkSession), "a", "b").mapInPandas(_accept, "a long, b long, cost double"), "accepted")
    links = _nearest(accepted)
    # the same letters with other blanks between them ("LosNirvindo") are one form: a star to the smallest, no pairs
    joined = parsed.select("glued", F.xxhash64(*by_form).alias("a")).distinct()
    stars = joined.join(joined.groupBy("glued").agg(F.min("a").alias("b")), "glued").select("a", "b").filter("a <> b")
    roots = connected_components(links.unionByName(stars))
    owned = materialise(forms.join(roots.withColumnRenamed("node", "form"), "form", "left").withColumn("root", F.coalesce("root", "form")), "owned")
    final, used = _resolve(owned)
    out = materialise(parsed.join(final, by_form).select("nombre", F.col("entidad")), "spellings")
    for table in (names, *made, parsed, forms, accepted, owned, *used):
        discard(table)
    return out


def _near_keys(core: str) -> set[str]:
    return {f"~{k}" for k in _sound_keys(core)}


def _offers(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each full form every key under which a shorter form may look for it, with the head that the form stands for."""
    for batch in batches:
        out = []
        for core, heads, duo, root in zip(batch["core"], batch["heads"], batch["duo"], batch["root"]):
            first = heads.split()
            short = {""}
            if duo:
                x, y = first[:2]
                short |= {"+" + " ".join(sorted(z)) for z in ((x[0] + ".", y[0] + "."), (x[0] + ".", y), (x, y[0] + "."))} | {f"=+{x} {y}"}
                what = "+" + heads
            elif first:
                x = first[0]
                short |= {x[0] + ".", "=" + x}
                if len(first) > 1:
                    y = first[1]
                    short |= {x, f"{x} {y[0]}.", f"{x[0]}. {y[0]}.", f"{x[0]}. {y}"}
                what = x
            else:
                continue
            for s in short:
                out += [(f"{k}/{s}", root, what, core) for k in ({core} | (_near_keys(core) if s else set()))]
        yield pd.DataFrame(out, columns=["key", "root", "what", "of"])


def _asks(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The keys under which a form that may be short for another one looks for its owner; rank 1 is the core as it is."""
    for batch in batches:
        out = []
        for core, heads, duo, root in zip(batch["core"], batch["heads"], batch["duo"], batch["root"]):
            ways = [""]
            for h in heads.split():
                ways = [f"{w} {x}".strip() for w in ways for x in h.split("|")]
            for way in ways:
                key = ("+" + " ".join(sorted(way.split()))) if duo else way
                key = "=" + key if "|" in heads and "." not in heads else key
                out.append((root, f"{core}/{key}", 1, core))
                if key:
                    out += [(root, f"{k}/{key}", 2, core) for k in _near_keys(core)]
        yield pd.DataFrame(out, columns=["root", "key", "rank", "core"])


def _agree(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["cost"] = pd.Series([core_cost(a, b) for a, b in zip(batch["core"], batch["of"])], index=batch.index, dtype="float64")
        yield batch.loc[batch["cost"].notna(), ["root", "rank", "lo", "hi", "what", "of", "cost"]]


def _resolve(owned: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(core, heads, duo, entidad), and the written tables that it reads: abbreviated forms take the artist they can only mean."""
    full = owned.filter(~F.col("initials")).select("core", "heads", "duo", "root")
    offers = spread(full, "core", "heads").mapInPandas(_offers, "key string, root long, what string, of string")
    owner = offers.filter(~F.col("key").startswith("~")).groupBy("key").agg(F.min("root").alias("owner"), F.min("what").alias("w1"), F.max("what").alias("w2")).filter("w1 = w2").select("key", "owner")
    short = owned.filter(F.col("initials") | (F.col("heads") == "") | (~F.col("duo") & ~F.col("heads").contains(" ") & (F.col("heads") != "@"))).select("core", "heads", "duo", "root")
    asks = materialise(spread(short, "core", "heads").mapInPandas(_asks, "root long, key string, rank int, core string").distinct(), "asks")
    exact = asks.filter("rank = 1").join(owner, "key").select("root", "rank", F.col("owner").alias("lo"), F.col("owner").alias("hi"), F.lit("").alias("what"), F.lit("").alias("of"))
    # a core that was mistyped as well: one row for each (core, head) that is offered, compared as other cores are
    near = offers.filter(F.col("key").startswith("~")).groupBy("key", "of", "what").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    near = asks.filter("rank = 2").join(near, "key").filter((F.col("core") != F.col("of")) & (F.levenshtein("core", "of", 3) >= 0)).select("root", "rank", "lo", "hi", "what", "core", "of").distinct()
    near = materialise(near.mapInPandas(_agree, "root long, rank int, lo long, hi long, what string, of string, cost double").filter("lo <> root or hi <> root"), "near")
    # of the cores that it may be, the nearest: the more artists there are, the more lie within reach of a mistyped core
    best = near.groupBy("root").agg(F.min("cost").alias("best"))
    nearest = near.join(best, "root").filter("cost = best").drop("cost", "best")
    found = exact.filter("lo <> root or hi <> root").unionByName(nearest)
    one = found.groupBy("root", "rank").agg(F.min("lo").alias("owner"), F.max("hi").alias("hi"), F.min("what").alias("w1"), F.max("what").alias("w2"), F.min("of").alias("of"), F.max("of").alias("o2"))
    one = one.filter("w1 = w2 and (owner = hi or rank = 2 and of = o2)").filter("owner <> root")
    to = materialise(one.groupBy("root").agg(F.min_by("owner", "rank").alias("owner")), "owners")
    # an owner may itself be short for another one: from an initial to a given name to a given and a middle name
    whole = connected_components(to, "root", "owner")
    final = owned.join(whole.select(F.col("node").alias("root"), F.col("root").alias("entidad")), "root", "left")
    return final.select("core", "heads", "duo", F.coalesce("entidad", "root").alias("entidad")), [asks, near, to]


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """(nombre_a, nombre_b): all pairs of spellings of one artist, in binary order."""
    a, b = linked.select("entidad", F.col("nombre").alias("nombre_a")), linked.select("entidad", F.col("nombre").alias("nombre_b"))
    return a.join(b, "entidad").filter(F.encode("nombre_a", "utf-8") < F.encode("nombre_b", "utf-8")).select("nombre_a", "nombre_b")


def artist_spellings(artists: DataFrame, tracks: DataFrame) -> DataFrame:
    """The stored spellings of ``artistas.nombre`` and ``pistas.artista_nombre``."""
    return artists.select("nombre").unionByName(tracks.select(F.col("artista_nombre").alias("nombre")))

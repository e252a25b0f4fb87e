"""Problem 4: same or near-same records across splits.

Texts become word sequences without layout; equal sequences are one class. Over the
classes runs an exact prefix-filter join between evaluation and training: the items are the
distinct words in one order for both sides (``word_codes``), rare ones among the evaluation texts first.
``same_comment`` implies a number of words in common (``_needed``), so two texts that are one
comment meet in a word before whose place on either side no more than the spare words stand. Single words serve as the
shingles because a quarter of the words changed can break every longer one of a short text. The work is parted by the
number of distinct words (``Bands``), so that every cell has close bounds; a text goes once to a cell, not once for every word.
Within a cell, texts that meet in a frequent word are told apart by the next word in common, and the next; what is left is
compared by a map of both word sets, whose differing bits bound the words in common from above, and then by all word codes.
None of it drops a pair that the comparison of all words and pairs of neighbouring words, which follows, would accept.

TESTDATA.md lets a quarter of the words differ, so the five-word similarity of 0.8 does not
apply: ``SIM`` and ``pair_least`` decide over all words of both texts.

Defined results: null and placeholder bodies, and texts of fewer than eight words, have no
partner; quoted lines do not count; repeated rows of a record count once; an empty table or
an empty side gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.texts import plain
from threadloom.session import staged

#: Hash buckets of the counts that say how rare a word is.
BUCKETS = 1 << 18
#: Codes of the words that no evaluation text holds.
EXTRA = 1 << 12
#: Evaluation texts that tell which words stand together.
SOME = 4_000
#: Training texts in one cell of the join; of the evaluation side a third.
HOT = 300_000
#: Pairs that meet in a word from which on the next word in common tells them apart, and up to which they are listed one by one.
LEAF, SMALL = 1_000_000, 2_048
#: Least word similarity of a pair: a quarter replaced leaves 0.75 / 1.25.
SIM = 0.58
#: Least similarity over pairs of neighbouring words, where ``pair_least`` does not ask for less.
PAIR_SIM = 0.33
#: Words of a remark that one text may have more.
REMARK = 8
LEAST = 8
EVAL = ("validation", "test")

# a line that begins with >! hides its text and quotes nothing
_QUOTED = re.compile(r"^\s*>(?!!).*$", re.M)
_ADDRESS = re.compile(r"\]\([^)]*\)|https?://\S+")
_INSIDE = re.compile(r"(?<=[^\W\d_])['*_~^`]+(?=[^\W\d_])|\u0307")
_WORD = re.compile(r"[^\W_]+")


def split_words(text: str) -> list[str]:
    """Lower-case words without markup, quoted lines, addresses and look-alike letters."""
    x = plain(text)
    if not x.isascii():
        x = unicodedata.normalize("NFKC", x)
    x = _ADDRESS.sub(" ", _QUOTED.sub(" ", x) if ">" in x else x).lower()
    return _WORD.findall(_INSIDE.sub("", x))


def word_list(body: Column) -> Column:
    """``split_words`` as a column."""
    return F.pandas_udf(lambda s: s.map(split_words), "array<string>")(body)


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` (``record_id, split, subreddit, link_id, cid``) and ``texts`` (``cid, words, n, ev, tr``)."""
    rows = records.filter("stimulus.body is not null").select(
        "record_id", "split", F.col("meta.subreddit").alias("subreddit"), F.col("meta.link_id").alias("link_id"), F.col("stimulus.body").alias("body")
    )
    rows = rows.filter(F.col("split").isin("train", *EVAL) & ~F.lower(F.trim("body")).isin("[removed]", "[deleted]"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [split_words(t) for t in b["body"]]
            b = b.drop(columns="body").assign(words=[" ".join(w) for w in each], n=[len(w) for w in each])
            yield b[b["n"] >= LEAST]

    rows = rows.mapInPandas(run, "record_id bigint, split string, subreddit string, link_id string, words string, n int")
    rows = staged(rows.withColumn("cid", F.xxhash64("words", F.lit(1))), "rows")
    members = rows.select("record_id", "split", "subreddit", "link_id", "cid").dropDuplicates(["record_id", "split", "cid"])
    texts = rows.groupBy("cid").agg(F.min("words").alias("words"), F.min("n").alias("n"), F.max((F.col("split") != "train").cast("int")).alias("ev"), F.max((F.col("split") == "train").cast("int")).alias("tr"))
    return members, staged(texts, "texts")


@cache
def pair_least(n: int) -> float:
    """Least similarity over pairs of neighbouring words, of which the shorter text has ``n`` words.

    As many words as ``SIM`` lets be replaced, none beside another, break two pairs each.
    """
    broken = 2 * int(n * (1 - SIM) / (1 + SIM) + 1e-9)
    return min(PAIR_SIM, (n - 1 - broken) / (n - 1 + broken))


def _needed(d, m):
    """Distinct words that texts of ``d`` and ``m`` distinct words have in common where they are one comment; it never falls as either grows."""
    return SIM * (d + m - np.minimum(REMARK, abs(d - m))) / (1 + SIM)


def _hashes(text: str, memo: dict[str, int]) -> np.ndarray:
    """Hashes of the distinct words."""
    words = set(text.split(" "))
    for w in words.difference(memo):
        memo[w] = xxhash.xxh64_intdigest(w)
    return np.array([memo[w] for w in words], dtype=np.uint64)


def bucket_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many of ``texts`` the words of each hash bucket stand, and how many texts have each number of distinct words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        total = np.zeros(BUCKETS, dtype=np.int64)
        sizes: Counter[int] = Counter()
        for b in batches:
            each = [_hashes(t, memo) for t in b["words"]]
            if each:
                total += np.bincount((np.concatenate(each) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                sizes.update(map(len, each))
            if len(memo) > 500_000:
                memo.clear()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"k": [*at, *(-d for d in sizes)], "n": [*total[at], *sizes.values()]}, dtype="int64")

    out, by = np.zeros(BUCKETS, dtype=np.int64), {0: 0}
    for r in texts.select("words").mapInPandas(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        if r["k"] < 0:
            by[-r["k"]] = r["n"]
        else:
            out[r["k"]] = r["n"]
    sizes = np.zeros(max(by) + 1, dtype=np.int64)
    sizes[list(by)] = list(by.values())
    return out, sizes


_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_codes(counts: np.ndarray, some: list[str]) -> np.ndarray:
    """The code of every word bucket; the codes are the one order of the words on both sides.

    Rarest among the evaluation texts first, but a frequent word that mostly stands with a rarer one comes after all that do not:
    so the words before are of different phrases and several of them in common say more. ``some`` texts tell which; they decide
    the order and with it the work, never the result. Buckets that share a code only raise the bound on the words in common.
    """
    memo: dict[str, int] = {}
    sets = [np.unique((_hashes(t, memo) % np.uint64(BUCKETS)).astype(np.int64)) for t in some]
    late = np.zeros(BUCKETS, dtype=bool)
    if sets:
        seen = np.bincount(np.concatenate(sets), minlength=BUCKETS)
        top = np.argsort(-seen, kind="stable")[:2048]
        top = top[seen[top] >= max(8, len(sets) // 200)]
        place = np.full(BUCKETS, -1)
        place[top] = np.arange(len(top))
        stands = np.zeros((len(sets), len(top)), dtype=np.float32)
        for i, s in enumerate(sets):
            stands[i, place[s][place[s] >= 0]] = 1
        both = stands.T @ stands
        heads: list[int] = []
        for k in np.argsort(np.diag(both), kind="stable"):
            if heads and both[k, heads].max() >= 0.6 * both[heads, heads][np.argmax(both[k, heads])]:
                late[top[k]] = True
            else:
                heads.append(k)
    out = np.arange(BUCKETS) % EXTRA
    known = np.flatnonzero(counts > 0)
    order = known[np.lexsort((known, counts[known], late[known]))]
    out[order] = EXTRA + np.arange(len(order)) * min(len(order), (1 << 16) - EXTRA) // max(1, len(order))
    return out.astype(np.uint16)


class Bands:
    """Texts of one side by their number of distinct words: ranges of a quarter at most, with at most ``most`` texts or, where one number alone has more, in parts by id."""

    def __init__(self, sizes: np.ndarray, most: int) -> None:
        low, high, held = [], [], []
        for d in np.flatnonzero(sizes):
            if low and d <= 1.25 * low[-1] and held[-1] + sizes[d] <= most:
                high[-1], held[-1] = d, held[-1] + sizes[d]
            else:
                low.append(d), high.append(d), held.append(sizes[d])
        self.low, self.high = np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)
        self.parts = 1 + (np.array(held, dtype=np.int64) - 1) // most
        self.base = np.concatenate(([0], np.cumsum(self.parts)))

    def cell(self, cid: np.ndarray, d: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.low, d, side="right") - 1
        return self.base[k] + cid % self.parts[k]

    def meeting(self, other: Bands) -> list[np.ndarray]:
        """For every cell of this side the cells of the other in which a text can have enough words in common."""
        out = []
        for low, high, n in zip(self.low, self.high, self.parts):
            above, below = _needed(other.low, high) <= high + 1e-6, _needed(low, other.high) <= other.high + 1e-6
            ok = np.where(other.low > high, above, np.where(other.high < low, below, True))
            out += [np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(other.base[k], other.base[k + 1]) for k in np.flatnonzero(ok)]])] * n
        return out


def coded(texts: DataFrame, codes: np.ndarray, bands: tuple[Bands, Bands], mine: int) -> DataFrame:
    """``cid, codes, g``: the sorted codes of the distinct words of a text, once for every cell ``g`` of the work; ``mine`` is the side of ``texts``."""
    known = texts.sparkSession.sparkContext.broadcast((codes, bands, bands[mine].meeting(bands[1 - mine]), int(bands[1].base[-1])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bands, meeting, wide = known.value
        memo: dict[str, int] = {}
        for b in batches:
            if not len(b):
                continue
            each = [_hashes(t, memo) for t in b["words"]]
            if len(memo) > 500_000:
                memo.clear()
            d = np.array([len(h) for h in each])
            code = table[(np.concatenate(each) % np.uint64(BUCKETS)).astype(np.int64)]
            row = np.repeat(np.arange(len(d)), d)
            code = (np.sort((row << 16) | code) & 0xFFFF).astype(np.uint16)
            text = np.array([c.tobytes() for c in np.split(code, np.cumsum(d)[:-1])] + [None], dtype=object)[:-1]
            cid = b["cid"].to_numpy()
            own = bands[mine].cell(cid, d)
            to = [meeting[k] for k in own]
            times = np.array([len(k) for k in to])
            other, own = np.concatenate(to), np.repeat(own, times)
            yield pd.DataFrame({"cid": np.repeat(cid, times), "codes": np.repeat(text, times), "g": own * wide + other if mine == 0 else other * wide + own})

    return texts.select("cid", "words").mapInPandas(run, "cid bigint, codes binary, g bigint")


class _Side:
    """Texts of one side of a cell: codes end to end, 256-bit maps in which every code flips one bit, and their folding to 128 bits."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.cid = rows["cid"].to_numpy()
        self.codes = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint16)
        self.d = np.array([len(c) // 2 for c in rows["codes"]], dtype=np.int64)
        self.start = np.cumsum(self.d) - self.d
        mix = (self.codes.astype(np.uint64) + np.uint64(1)) * _MIX
        bit, part = np.uint64(1) << ((mix >> np.uint64(56)) & np.uint64(63)), mix >> np.uint64(62)
        self.map = np.stack([np.bitwise_xor.reduceat(np.where(part == np.uint64(j), bit, np.uint64(0)), self.start) for j in range(4)])
        self.fold = np.stack([self.map[0] ^ self.map[1], self.map[2] ^ self.map[3]])

    def bound(self, least: int) -> None:
        """``need``: words in common with any text of ``least`` or more distinct words, with room for rounding."""
        self.need = _needed(self.d, least) - 1e-2
        self.spare = np.floor(self.d - self.need).astype(np.int64)

    def entries(self, rows: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Runs of equal codes (code, begin, length), text and place of the words after ``at`` that can be the next in common after ``k``."""
        n = np.maximum(0, np.minimum(self.d[rows] - 1, self.spare[rows] + k) - at)
        each = np.repeat(np.arange(len(rows), dtype=np.int32), n)
        j = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + at[each] + 1
        code = self.codes[self.start[rows][each] + j]
        order = np.argsort(code, kind="stable")
        code = code[order]
        begin = np.flatnonzero(np.concatenate(([len(code) > 0], code[1:] != code[:-1]))) if len(code) else np.zeros(0, dtype=np.int64)
        return code[begin], begin, np.diff(np.append(begin, len(code))), rows[each[order]], j[order]


def _met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Pairs ``e, t`` of one cell whose codes have as many in common as the same comment needs.

    Texts meet in their first word in common. Where more than ``LEAF`` pairs meet in one word, they are told apart by the next
    word in common, and so on as long as all of them need one more. What is left is compared by maps, then by all codes.
    """
    if left.empty or right.empty:
        return pd.DataFrame({"e": np.zeros(0, dtype=np.int64), "t": np.zeros(0, dtype=np.int64)})
    e, t = _Side(left), _Side(right)
    e.bound(int(t.d.min()))
    t.bound(int(e.d.min()))
    low, high, half = int(t.d.min()), int(t.d.max()), SIM / (1 + SIM)
    most = (1 - 2 * half) * (e.d + high) + 2 * half * np.minimum(REMARK, np.maximum(abs(e.d - low), abs(e.d - high))) + 2e-2
    most = np.minimum(255, most).astype(np.uint8)
    found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
    held = 0

    def kept(p: np.ndarray, q: np.ndarray) -> None:
        nonlocal held
        both = e.d[p] + t.d[q]
        need = _needed(e.d[p], t.d[q]) - 1e-2
        differ = np.zeros(len(p), dtype=np.int64)
        for j in range(4):
            differ += np.bitwise_count(e.map[j][p] ^ t.map[j][q])
        ok = differ <= both - 2 * need
        found.append(p[ok].astype(np.int64) * len(t.d) + q[ok])
        held += len(found[-1])
        if held > 2_000_000:
            found[:] = [np.unique(np.concatenate(found))]
            held = len(found[0]) // 2

    def block(p: np.ndarray, q: np.ndarray) -> None:
        wide = 4096
        for at in range(0, len(q), wide):
            qs = q[at : at + wide]
            t0, t1 = t.fold[0][qs], t.fold[1][qs]
            step = max(1, 32_768 // len(qs))
            for low in range(0, len(p), step):
                ps = p[low : low + step]
                differ = np.bitwise_count(e.fold[0][ps][:, None] ^ t0)
                differ += np.bitwise_count(e.fold[1][ps][:, None] ^ t1)
                i, j = np.divmod(np.flatnonzero(differ <= most[ps][:, None]), len(qs))
                if len(i):
                    kept(ps[i], qs[j])

    def descend(er: np.ndarray, ea: np.ndarray, tr: np.ndarray, ta: np.ndarray, k: int, whole: float = np.inf) -> None:
        parent = er, tr
        code_e, at_e, n_e, er, ea = e.entries(er, ea, k)
        code_t, at_t, n_t, tr, ta = t.entries(tr, ta, k)
        _, x, y = np.intersect1d(code_e, code_t, assume_unique=True, return_indices=True)
        at_e, n_e, at_t, n_t = at_e[x], n_e[x], at_t[y], n_t[y]
        pairs = n_e * n_t
        if pairs.sum() > 0.7 * whole:  # copies that share most words: the next word tells none apart
            block(*parent)
            return
        for z in np.flatnonzero(pairs > SMALL):
            p, q = slice(at_e[z], at_e[z] + n_e[z]), slice(at_t[z], at_t[z] + n_t[z])
            if pairs[z] > LEAF and min(e.need[er[p]].min(), t.need[tr[q]].min()) > k + 1:
                descend(er[p], ea[p], tr[q], ta[q], k + 1, pairs[z])
            else:
                block(er[p], tr[q])
        few = np.flatnonzero(pairs <= SMALL)
        for low in range(0, len(few), 64):
            z = few[low : low + 64]
            n = pairs[z]
            w = np.repeat(z, n)
            k_ = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.divmod(k_, n_t[w])
            kept(er[at_e[w] + i], tr[at_t[w] + j])

    rows = lambda s: np.flatnonzero(s.need <= s.d)
    er, tr = rows(e), rows(t)
    descend(er, np.full(len(er), -1), tr, np.full(len(tr), -1), 0)
    pairs = np.unique(np.concatenate(found))
    out_e, out_t = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for low in range(0, len(pairs), 20_000):
        p, q = np.divmod(pairs[low : low + 20_000], len(t.d))
        same = _in_common(e, p, t, q) >= _needed(e.d[p], t.d[q]) - 1e-2
        out_e.append(e.cid[p[same]])
        out_t.append(t.cid[q[same]])
    return pd.DataFrame({"e": np.concatenate(out_e), "t": np.concatenate(out_t)}).query("e != t")


def _in_common(e: _Side, p: np.ndarray, t: _Side, q: np.ndarray) -> np.ndarray:
    """Codes in common of each pair; a code that a text has several times counts as often as both have it."""
    keys = []
    for side, rows in ((e, p), (t, q)):
        n = side.d[rows]
        pair = np.repeat(np.arange(len(rows)), n)
        key = (pair << 16) | side.codes[np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(side.start[rows], n)]
        # sorted already: the pairs follow one another, and so do the codes of each; copies of a code are numbered
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        keys.append((key << 16) | (np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))))
    same = np.sort(np.concatenate(keys), kind="stable")
    return np.bincount(same[1:][same[1:] == same[:-1]] >> 32, minlength=len(p))


def candidates(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """``e, t``: evaluation and training class with enough codes in common; equal classes are left out. ``hot`` bounds the training texts of a cell."""
    ev, tr = texts.filter("ev = 1"), texts.filter("tr = 1")
    (counts, sizes_e), (_, sizes_t) = bucket_counts(ev), bucket_counts(tr)
    codes = word_codes(counts, [r["words"] for r in ev.select("words").limit(SOME).collect()])
    bands = Bands(sizes_e, max(1, hot // 3)), Bands(sizes_t, hot)
    index, probe = coded(ev, codes, bands, 0), coded(tr, codes, bands, 1)
    return index.groupBy("g").cogroup(probe.groupBy("g")).applyInPandas(lambda e, t: _met(e, t), "e bigint, t bigint")


def similarity(n: int, m: int, both: int) -> float:
    """Shared items over all items; what a short remark adds to one side is free."""
    return both / max(1, n + m - both - min(REMARK, abs(n - m)))


def same_comment(a: str, b: str) -> bool:
    """Whether two word sequences are one comment by their distinct words and their pairs of neighbouring words."""
    x, y = a.split(" "), b.split(" ")
    p, q = set(x), set(y)
    if similarity(len(p), len(q), len(p & q)) < SIM:
        return False
    u, v = Counter(zip(x, x[1:])), Counter(zip(y, y[1:]))
    return similarity(len(x) - 1, len(y) - 1, (u & v).total()) >= pair_least(min(len(x), len(y)))


def _similar(a: Column, b: Column) -> Column:
    @F.pandas_udf("boolean")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([same_comment(p, q) for p, q in zip(x, y)], dtype="bool")

    return of(a, b)


def links(texts: DataFrame) -> DataFrame:
    """``e, t`` of evaluation and training classes that hold the same comment, equal classes included."""
    cand = staged(candidates(texts), "candidates")
    a = texts.select(F.col("cid").alias("e"), F.col("words").alias("we"))
    b = texts.select(F.col("cid").alias("t"), F.col("words").alias("wt"))
    near = cand.join(a, "e").join(b, "t").filter(_similar(F.col("we"), F.col("wt"))).select("e", "t")
    same = texts.filter("ev = 1 and tr = 1").select(F.col("cid").alias("e"), F.col("cid").alias("t"))
    return near.unionByName(same)


def class_links(records: DataFrame) -> DataFrame:
    """Pairs without expanded copies: ``evaluation, training``, each the least record id of a class of equal texts on its side."""
    members, texts = classes(records)
    least = members.groupBy("cid", (F.col("split") == "train").alias("train")).agg(F.min("record_id").alias("record_id"))
    e = least.filter("not train").select(F.col("cid").alias("e"), F.col("record_id").alias("evaluation"))
    t = least.filter("train").select(F.col("cid").alias("t"), F.col("record_id").alias("training"))
    return links(texts).join(e, "e").join(t, "t").select("evaluation", "training").distinct()


def class_members(records: DataFrame) -> DataFrame:
    """``record_id, split, class_id``: ``class_id`` is the least record id of the class of equal texts on the side of the split."""
    members, _ = classes(records)
    train = F.col("split") == "train"
    least = members.groupBy("cid", train.alias("train")).agg(F.min("record_id").alias("class_id"))
    return members.withColumn("train", train).join(least, ["cid", "train"]).select("record_id", "split", "class_id").distinct()


def found(records: DataFrame) -> DataFrame:
    """``record_id_a, record_id_b``: one training and one evaluation record, the smaller id first."""
    members, texts = classes(records)
    pairs = links(texts)
    ev = members.filter("split <> 'train'").select(F.col("cid").alias("e"), F.col("record_id").alias("x"))
    tr = members.filter("split = 'train'").select(F.col("cid").alias("t"), F.col("record_id").alias("y"))
    return pairs.join(ev, "e").join(tr, "t").filter("x <> y").select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b")).distinct()


def report(records: DataFrame) -> DataFrame:
    """Records with a partner on the other side, per ``split, subreddit, link_id``: ``n_records, n_links``; copies are not expanded into pairs."""
    members, texts = classes(records)
    pairs = staged(links(texts), "links")
    side = members.groupBy("cid", (F.col("split") == "train").alias("train")).agg(F.count_distinct("record_id").alias("m"))
    ev_n = side.filter("not train").select(F.col("cid").alias("e"), "m")
    tr_n = side.filter("train").select(F.col("cid").alias("t"), "m")
    partners = pairs.join(tr_n, "t").groupBy(F.col("e").alias("cid")).agg(F.sum("m").alias("links")).withColumn("train", F.lit(False))
    partners = partners.unionByName(pairs.join(ev_n, "e").groupBy(F.col("t").alias("cid")).agg(F.sum("m").alias("links")).withColumn("train", F.lit(True)))
    hit = members.withColumn("train", F.col("split") == "train").join(partners, ["cid", "train"])
    return hit.groupBy("split", "subreddit", "link_id").agg(F.count_distinct("record_id").alias("n_records"), F.sum("links").alias("n_links"))

"""Problem 5: template residue and error-page text.

Texts are cut into segments (sentences and lines). Two things are trusted:

* forms: unfilled fields, markup of a page, an error object, filler words. A field marks the
  segment it stands in and nothing else, because a filled copy of a template is a complete notice;
  near-duplicates of the other forms are residue like them.
* messages: a short list of messages as web servers and frameworks send them.

Distinct segments get a 192-bit SimHash of their words and stand in ``TABLES`` tables, keyed by
24 of its bits. Keys within ``FLIPS`` bits of each other meet, so two
hashes that differ in at most ``TABLES * (FLIPS + 1) - 1`` = 23 bits always meet, and two segments
of which one word in ten differs meet in about 95 of 100 cases. Who meets is compared by Hamming
distance and by common words; the label goes on from what it reached, round after round, until
no component grows. Only components with a trusted message or form are walked.

Before a round, a scan without shuffle drops the segments that the comparison of words would refuse
beside every label: of two segments with ``ALIKE`` common words, the first word in common, rarest
first, is among the rarest fifth (and one more) of either. Only what is left is written to the tables.

Defined results: null, empty, ``[removed]`` and ``[deleted]`` texts are no cases; texts are
read whole; repeated rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.texts import plain, record_texts
from threadloom.session import staged

#: Tables of 24 bits each, and the bits of a key that a lookup may flip.
TABLES, FLIPS = 8, 2
#: Most bits of 192 in which near-duplicates differ, and the least share of common words (Jaccard).
HAMMING, ALIKE = 48, 0.8
#: Labelled segments up to which the lookups (``TABLES`` times 301 short rows each at most) are broadcast; beyond it both sides are shuffled by key.
BROADCAST = 256
#: Hash buckets of the counts that say how rare a word is; bits of the map of the labels' rare words, and the distance in it from one class of length to the next.
BUCKETS, BITS, STEP = 1 << 18, 1 << 22, 1_640_531

# Segments that are residue wherever they stand, on the text as written.
FIELD = [
    r"\{\{[#/^&>!]?\s*[\w.\s|]+\}\}", r"\{%.*?%\}", r"<%.*?%>", r"<\?(?:php|=)?.*?\?>", r"\$\{[\w.\s]+\}", r"#\{[\w.]+\}",
    r"(?<![\w$])\$[A-Z][A-Z_]{2,}\$?(?![\w])", r"(?<![\w%])%[A-Z][A-Z_]{2,}%(?![\w%])", r"@@[A-Z_]{3,}@@", r"(?<!\w)__[A-Z][A-Z_]{2,}?__(?!\w)", r"\[\[[A-Z][A-Z_ ]{2,}\]\]",
    r"\[(?:INSERT|YOUR|ENTER|ADD|FIRST|LAST|COMPANY|NAME|DATE|TITLE|PLACEHOLDER|TODO|TBD)\b[A-Z _\-]*\](?!\()", r"<[a-z]+(?:_[a-z]+)+>", r"<(?:first|last|user|insert|your)[ _-]?name>", r"(?<![\w{])\{(?:\d+|[a-z]+_[a-z_]+)\}(?!\})",
    r"\[object Object\]", r"\bNaN (?:days|hours|minutes|points|comments)\b", r"(?:^|\b(?:hi|hey|dear|hello|welcome) )undefined\b(?=[,!])",
]
# How markup of a page, an error object and a traceback begin, lower case.
PAGE = re.compile(r"\W*<(?:!doctype|html|head|body|title|noscript)\b|\W*\{?\s*\"(?:error|status|code|errors)\"\s*:|traceback \(most recent call last\)")
# Messages that are trusted to be residue.
MESSAGES = """
404 Not Found
403 Forbidden
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
Page not found.
Access denied.
Permission denied.
Session expired.
Too many requests.
An unexpected error has occurred.
Your session has expired, please sign in again.
Service temporarily unavailable (503).
Error establishing a database connection
You do not have permission to view this page.
The requested URL was not found on the server.
Sorry, but this page isn't available.
The link you followed may be broken, or the page may have been taken offline.
502 Bad Gateway - the upstream server did not answer in time, try again in a few minutes.
Gateway timeout: the server took too long to answer, 30000 ms elapsed, request 1.
Checking your browser before opening the forum page.
Please turn on JavaScript in your browser, then reload the page to continue.
You need to enable JavaScript to run this app.
Your browser has JavaScript switched off or does not support it.
This site requires scripts to display the comments.
This site requires JavaScript.
NOSCRIPT: images and replies are hidden because scripting is off
TODO: write the announcement here before the thread goes live.
Your comment text here.
Insert paragraph here.
Text goes here.
Sample body text, replace this text.
Comment content coming soon.
This is placeholder text.
Seite nicht gefunden.
Zugriff verweigert.
Ihre Sitzung ist abgelaufen.
Die angeforderte Adresse existiert nicht mehr oder wurde verschoben.
Bitte aktivieren Sie JavaScript, um den Inhalt dieser Seite anzuzeigen.
Page non trouvée.
Accès refusé.
Votre session a expiré.
Erreur 404 : la page que vous cherchez n'existe pas.
Veuillez activer JavaScript pour afficher cette page.
Página no encontrada.
Acceso denegado.
Su sesión ha caducado.
Por favor vuelva a iniciar sesión para ver este contenido.
Active JavaScript para ver esta página.
""".strip().split("\n")
# Short words that persons say again and again.
SPOKEN = frozenset("no na nah ha he hi ho heh hee hah la da oh ah eh uh um hm so go yes yay yep hey bye wow boo now ja nein si sí oui non bla aye mu ya yo out why way too far big old bad how tut run win up on do we you me it ok".split())
# The words of Latin filler text.
LATIN = frozenset("""
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud
exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum pharetra senectus netus fames malesuada egestas
pellentesque habitant morbi tristique augue mauris vestibulum proin sagittis lacus faucibus rutrum vivamus ac
""".split())

_FIELD = re.compile("|".join(FIELD))
_FIELD_CHARS = re.compile(r"[{}<>$%@\[_]|NaN|undefined")
_CODE_QUOTE = re.compile(r"`[^`]*`")
_LOW = re.compile(r"[^\W\d_]+")
_CUT = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[^\W_]+")


def segments(text: str) -> list[str]:
    """Sentences and lines of a text; a quoted or bulleted line keeps its mark."""
    return [s for s in (x.strip() for x in _CUT.split(plain(text))) if s]


def masked(segment: str) -> str:
    """Words of a segment in lower case, one zero for every number and code."""
    return " ".join(w if w.isalpha() else "0" for w in _WORD.findall(segment.lower()))


def _filler(words: list[str]) -> bool:
    """Words of two letters or more that stand there again and again, and nothing else but at most one more such word or a plea to ignore it; short words of speech are none."""
    own = [w for w in words if w not in ("please", "ignore", "this")]
    return len(own) >= 3 and min(map(len, own)) >= 2 and SPOKEN.isdisjoint(own) and len(set(own)) <= 2 and max(sum(1 for _ in g) for _, g in groupby(own)) >= 3


def field(segment: str) -> bool:
    """Whether an unfilled field stands in a segment."""
    return bool(_FIELD_CHARS.search(segment) and _FIELD.search(_CODE_QUOTE.sub(" ", segment)))


def form(segment: str) -> int:
    """1 where the form of a segment makes it residue."""
    if field(segment):
        return 1
    low = segment.lower().lstrip("*>_#-• \t\"'(")
    words = _LOW.findall(low)
    if len(words) > 2 and words[0] in LATIN and words[1] in LATIN and sum(x in LATIN for x in words) >= 0.75 * len(words):
        return 1
    if len(words) >= 3 and _filler(words) or low.startswith("xxx") and set(low) <= set("x .-"):
        return 1
    return int(PAGE.match(segment.lower()) is not None)


#: Least number of distinct words of each class of length; a segment stands at most one class from any with ``ALIKE`` = 4 / 5 common words.
_LENGTHS = [1]
while _LENGTHS[-1] < 1 << 40:
    _LENGTHS.append(_LENGTHS[-1] * 5 // 4 + 1)
_LENGTHS = np.array(_LENGTHS)


class SimHash:
    """192-bit SimHash over the distinct words of texts, as three longs, and the codes of their rarest words, a batch at a time."""

    def __init__(self) -> None:
        self.words: dict[str, bytes] = {}

    def digests(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """32 bytes for every distinct word of every text, and the number of distinct words of each text."""
        flat, sizes = [], []
        for t in texts:
            w = set(t.split(" "))
            for x in w:
                if x not in self.words:
                    if len(self.words) > 500_000:
                        self.words.clear()
                    # the last eight bytes are Spark's own hash of the word
                    self.words[x] = xxhash.xxh128_digest(x) + xxhash.xxh64_digest(x, 7) + xxhash.xxh64_digest(x, 42)
                flat.append(self.words[x])
            sizes.append(len(w))
        return np.frombuffer(b"".join(flat), dtype=np.uint8).reshape(-1, 32), np.array(sizes, dtype=np.int64)

    @staticmethod
    def sims(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(sizes):
            return np.zeros((0, 3), dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        ones = np.add.reduceat(np.unpackbits(words[:, :24], axis=1), starts, axis=0, dtype=np.int32)
        return np.packbits(2 * ones > sizes[:, None], axis=1).view(np.int64).reshape(-1, 3)

    @staticmethod
    def rare(words: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes below ``BITS`` of the rarest words of each text and of its class of length, and where each text's codes begin."""
        word = words[:, 24:].copy().view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((word, counts[(word % np.uint64(BUCKETS)).astype(np.int64)], np.repeat(np.arange(len(sizes)), sizes)))
        least = sizes // 5 + 1
        first = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(least, sizes)
        length = np.repeat(np.searchsorted(_LENGTHS, sizes, side="right"), least)
        codes = ((word[order][first] >> np.uint64(42)).astype(np.int64) + length * STEP) % BITS
        return codes.astype(np.int32), np.concatenate(([0], np.cumsum(least))).astype(np.int32)


def segment_rows(texts: DataFrame) -> DataFrame:
    """``record_id, comment_id, seg, label, words`` of every segment of every text; ``label`` is 1 where the form decides; of a segment with a field ``words`` is empty. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[str, int]] = {}
        for b in batches:
            at, norm, label = [], [], []
            for i, t in enumerate(b["body"]):
                for s in dict.fromkeys(segments(t)) if t.strip() not in ("[removed]", "[deleted]") else ():
                    if s not in memo:
                        if len(memo) > 200_000:
                            memo.clear()
                        memo[s] = ("", 1) if field(s) else (masked(s), form(s))
                    if any(memo[s]):
                        at.append(i)
                        norm.append(memo[s][0])
                        label.append(memo[s][1])
            if not at:
                continue
            out = b[["record_id", "comment_id"]].iloc[at].reset_index(drop=True)
            out["label"] = np.array(label, dtype=np.int32)
            out["words"] = norm
            yield out

    schema = "record_id bigint, comment_id string, label int, words string"
    return texts.select("record_id", "comment_id", "body").mapInPandas(run, schema).withColumn("seg", F.xxhash64("words"))


def word_counts(rows: DataFrame) -> np.ndarray:
    """How often the words of each hash bucket stand in the segments of ``rows``."""
    word = rows.select(F.explode(F.split("words", " ")).alias("w"))
    got = word.groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("k")).agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out


def with_sims(distinct: DataFrame, counts: np.ndarray | None = None) -> DataFrame:
    """``seg, words`` plus the SimHash ``s0, s1, s2`` and ``rare``, the codes of the rarest words by ``counts``; all that are compared need the same counts."""
    order = np.zeros(BUCKETS, dtype=np.int64) if counts is None else counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sim = SimHash()
        for b in batches:
            words, sizes = sim.digests(b["words"].to_pylist())
            codes, starts = sim.rare(words, sizes, order)
            sims = [pa.array(x) for x in np.ascontiguousarray(sim.sims(words, sizes).T)]
            yield pa.RecordBatch.from_arrays([b["seg"], b["words"], *sims, pa.ListArray.from_arrays(starts, codes)], ["seg", "words", "s0", "s1", "s2", "rare"])

    return distinct.select("seg", "words").mapInArrow(run, "seg bigint, words string, s0 bigint, s1 bigint, s2 bigint, rare array<int>")


def _keys() -> Column:
    """The ``TABLES`` keys of a SimHash; all 192 bits stand in one of them."""
    part = lambda c, at, n: F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << n) - 1))
    keys = [part(c, at, 24) for c in ("s0", "s1", "s2") for at in (0, 24)]
    keys += [part(a, 48, 16) + F.shiftleft(part("s2", at, 8), 16) for a, at in (("s0", 48), ("s1", 56))]
    return F.array(*[k + (i << 24) for i, k in enumerate(keys)])


def _alike(a: str, b: str) -> Column:
    x, y = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(x, y)) >= ALIKE * F.size(F.array_union(x, y))


def sharing(open_: DataFrame, frontier: DataFrame) -> DataFrame:
    """The open segments that hold a rare word of one of the frontier of like length: every one that ``_alike`` accepts beside it, and few others. No shuffle of ``open_``; the map of ``BITS`` bits is broadcast."""
    code = frontier.select(F.explode("rare").alias("c")).distinct().select(F.explode(F.array(*[F.pmod(F.col("c") + F.lit(d), F.lit(BITS)) for d in (-STEP, 0, STEP)])).alias("c"))
    got = code.groupBy(F.shiftright("c", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, c & 63))").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, dtype=np.int64)
    bits[got["at"].to_numpy()] = got["bits"].to_numpy()
    table = open_.sparkSession.createDataFrame([(bits.tolist(),)], "bits array<bigint>")
    return open_.join(F.broadcast(table), F.expr("exists(rare, c -> bit_get(get(bits, shiftright(c, 6)), c & 63) = 1)"), "left_semi")


def _flips(most: int) -> list[int]:
    """The numbers of 24 bits of which at most ``most`` are set."""
    return [sum(1 << i for i in at) for n in range(most + 1) for at in combinations(range(24), n)]


def near(open_: DataFrame, frontier: DataFrame) -> DataFrame:
    """The rows of the open segments that are near-duplicates of one of the frontier."""
    n, m = open_.count(), frontier.count()
    # two keys within FLIPS bits meet however the flips are dealt out between them: the way with the fewest rows is taken
    own = min(range(FLIPS + 1), key=lambda x: n * len(_flips(x)) + m * len(_flips(FLIPS - x)))
    # by size the planner would broadcast the lookups, which it takes for as small as the frontier
    mark = F.broadcast if m <= BROADCAST else (lambda df: df.hint("merge"))

    def keyed(df: DataFrame, name: str, flips: int) -> DataFrame:
        keys = df.select(F.explode(_keys()).alias("k"), F.col("seg").alias(name), *[F.col(f"s{i}").alias(f"{name}{i}") for i in range(3)])
        return keys.select(F.explode(F.array(*map(F.lit, _flips(flips)))).alias("m"), "*").withColumn("k", F.col("k").bitwiseXOR(F.col("m"))).drop("m")

    differ = sum((F.bit_count(F.col(f"o{i}").bitwiseXOR(F.col(f"f{i}"))) for i in range(3)), F.lit(0))
    met = keyed(open_, "o", own).join(mark(keyed(frontier, "f", FLIPS - own)), "k").filter(differ <= HAMMING).select("o", "f").distinct()
    texts = frontier.select(F.col("seg").alias("f"), F.col("words").alias("w0"))
    alike = met.join(texts, "f").join(open_.select(F.col("seg").alias("o"), "words"), "o").filter(_alike("words", "w0"))
    return open_.join(alike.select(F.col("o").alias("seg")), "seg", "left_semi")


def residue_segments(rows: DataFrame, messages: list[str] | None = None, most_rounds: int | None = None) -> DataFrame:
    """``seg`` of the segments in components with a trusted message or form; ``most_rounds`` cuts the spreading short (for comparison)."""
    spark = rows.sparkSession
    texts = rows.filter("label = 0").select("seg", "words")
    counts = word_counts(texts)
    # equal words have an equal hash, so one row of a segment is as good as another
    open_ = staged(with_sims(texts.dropDuplicates(["seg"]), counts), "segments")
    lines = spark.createDataFrame([(masked(m),) for m in messages or MESSAGES], "words string").distinct().select(F.xxhash64("words").alias("seg"), "words")
    forms = rows.filter("label = 1 and size(array_distinct(split(words, ' '))) >= 3").select("seg", "words")
    frontier = known = staged(with_sims(lines.unionByName(forms).dropDuplicates(["seg"]), counts), "trusted")
    rounds = 0
    while most_rounds is None or rounds < most_rounds:
        fresh = staged(sharing(open_, frontier).join(known.select("seg"), "seg", "left_anti"), "fresh")
        frontier = staged(near(fresh, frontier), "frontier")
        if frontier.isEmpty():
            break
        known = staged(known.unionByName(frontier), "known")
        rounds += 1
    return known.select("seg")


def found(records: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Cases: distinct ``record_id, comment_id`` of texts that hold a residue segment."""
    rows = staged(segment_rows(record_texts(records)), "rows")
    hit = rows.filter("label = 0").join(residue_segments(rows, most_rounds=most_rounds), "seg", "left_semi")
    return rows.filter("label = 1").select("record_id", "comment_id").unionByName(hit.select("record_id", "comment_id")).distinct()


def kept(records: DataFrame) -> DataFrame:
    """Every distinct text with ``excluded`` set where it is a case: ``record_id, comment_id, excluded``."""
    every = record_texts(records).select("record_id", "comment_id").distinct()
    hit = found(records).withColumn("hit", F.lit(True))
    cond = (every.record_id.eqNullSafe(hit.record_id)) & (every.comment_id.eqNullSafe(hit.comment_id))
    return every.join(hit, cond, "left").select(every.record_id, every.comment_id, F.coalesce("hit", F.lit(False)).alias("excluded"))

"""Problem 3: personal information inside free text.

Bootstrapped contextual extraction. One pass over all texts lists candidate spans: forms that
are certain by themselves (seeds: an address with an ``@``, a number grouped like a phone number,
a street word with a house number, a common given name before a surname) and forms that are not
(bare digits, codes, two capitalised words, capitalised words after a number). The words left and
right of a candidate are its patterns. Spark then scores the bipartite graph of patterns and
instances in turns: a pattern is worth the mean of what it extracts, an unseeded instance (a digit
shape, a given name, a surname) the mean of the patterns that extract it. Spans whose instance and
pattern scores together reach ``ACCEPT`` are personal information of the best kind.

The graph is aggregated per (instance, pattern) before any join and never leaves the executors.

Defined results: null and empty texts hold nothing; texts are read whole; a name inside an e-mail
address is no name; repeated rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.texts import record_texts
from threadloom.session import staged

KINDS = ["email", "phone", "id_number", "street_address", "person_name"]
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}
ROUNDS = 4
ACCEPT = 0.5
#: Evidence a pattern or instance must outweigh: its scores are means over this many more neutral uses.
PRIOR = 1.0
#: How much a use of which nothing is known yet counts against a pattern.
UNKNOWN = 0.2
#: Least score of the given name of a name that no seed marks.
GIVEN_LEAST = 0.35
#: Least score of a given name that is looked for in any case, and of what stands around it or of its surname.
NAME, NEAR = 0.5, 0.2
#: Score of a given name that needs nothing around it.
SURE = 0.75
#: Bits of the filter of given names that goes to every worker; names that share a bit are told apart by a join.
NAME_BITS = 1 << 20

# Seed entities, a few common given names of the four languages.
GIVEN = frozenset("anna carlos carmen david emma hans helen jean john karin laura maria marie mary michael paul peter pierre sofia thomas".split())
# Titles before a surname.
TITLE = r"(?:Mr|Mrs|Ms|Mx|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora?|Sra?|Don|Doña|Sir|Lady)"
# Words before a number that is neither a phone nor an identity number.
NOT_PERSONAL = frozenset("""
ticket isbn issn docket version rule lot page pages grid reference ref vote match line thread case article section issue order invoice bill law paragraph chapter volume edition
build release room model serial item bus route flight track episode season budget error code docket no nr aktenzeichen aktennummer seite zeile artikel ley página référence dossier
sold needs says was ended oclc doi rfc commit port
""".split())
# Words that say what a number is, whatever its form.
SAYS_PHONE = frozenset("tel tél phone call cell mobile fax whatsapp ring text dial appelez telefon handy teléfono llámame móvil téléphone telephone".split())
SAYS_ID = frozenset("ssn passport passeport pasaporte personalausweis ausweisnummer dni taxpayer identité identidad insurance identity nie nif reisepass steuernummer sozialversicherungsnummer".split())

_LOCAL = r"[A-Za-z0-9][\w.+\-]*"
EMAIL = re.compile(
    rf"(?:mailto:)?{_LOCAL}@[\w\-]+(?:\.[\w\-]+)+"
    rf"|{_LOCAL}\s?(?:\[at\]|\(at\)|\{{at\}}|<at>)\s?[\w\-]+(?:\s?(?:\[dot\]|\(dot\)|\{{dot\}}|\.|\sdot\s)\s?[\w\-]+)+"
    rf"|{_LOCAL}(?: dot [\w\-]+)* at [\w\-]+(?:\.[\w\-]+)*(?: dot [\w\-]+)+",
    re.I,
)
NUMBER = re.compile(r"(?<![\w@#/.:,\-])(?:\+\d{1,3}[ .\-/]?)?\(?\d[\d ().\-/]{5,20}\d(?![\w@])(?![.,:/\-]\d)(?:\s?(?:ext|x|poste|durchwahl|extensión)\.?\s?\d{1,5})?", re.I)
CODE = re.compile(r"(?<![\w@#/.\-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]\d{8}|\d{8}-?[A-Z]|[A-Z]\d{7}-?[A-Z]|[A-Z]{1,2}\d{6,9})(?![\w@\-])")
_SKIP = r"(?!(?:the|at|of|in|on|and|or|for|to|by|main|per|page|pages|says|applies|votes|weeks|years|percent|million|street|said|a|an|is|was|with)\b)"
_SUFFIX = r"(?:street|str?|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|boulevard|blvd|way|place|pl|terrace|square|sq|close|crescent|parkway|pkwy|alley|highway|hwy)"
#: A house number and what follows it; matched at every number.
NUMBER_FIRST = re.compile(
    rf"\d{{1,5}}[a-z]? (?:{_SKIP}[a-zà-ÿ'\-]{{2,}} ){{1,3}}{_SUFFIX}\b\.?(?:,? (?:#|apt\.?|unit|suite) ?\w{{1,5}})?(?:, [a-zà-ÿ\-]+(?: [a-z]{{2}})? \d{{5}})?"
    r"|\d{1,4}(?: ?(?:bis|ter|quater|[a-d]))?,? (?:rue|avenue|chemin|boulevard|bd|place|allée|impasse|quai|route|cours|square)(?: (?:de la|de l'|des|du|de|d'))? ?[a-zà-ÿ'\-]+(?: [A-ZÀ-Ý][\wà-ÿ'\-]+){0,3}",
    re.I,
)
FLAT = re.compile(r"\b(?:apt|apartment|flat|unit|suite)\.? ?\w{1,4}, $", re.I)
#: A street and the house number that ends it; searched only in the words before a number.
NUMBER_LAST = re.compile(
    r"(?<![\w\-])[a-zäöüß\-]+(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer) ?\d{1,4}(?!\d)(?: ?[a-z]\b)?(?:, \d{5} [a-zäöüß\-]+)?"
    r"|(?<!\w)(?:calle|c/|avda\.?|av\.|avenida|plaza|paseo|camino|carrera|ronda|travesía)(?: (?:de los|de las|de la|del|de))? [a-zà-ÿ'\-]+(?: (?:de los|de la|del|de|[a-zà-ÿ'\-]+)){0,3}?,? (?:n\.?º ?)?\d{1,4}(?:, (?:bajo|ático|\d{1,2}\.?º(?: [a-z]\b)?))?",
    re.I,
)
#: What every match of ``NUMBER_LAST`` holds, lower case.
_LAST_WORDS = re.compile(r"(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer) ?\d|(?:calle|c/|avda\.?|av\.|avenida|plaza|paseo|camino|carrera|ronda|travesía) ")
#: A number that may end an address; one that may begin an address has none of ``_INSIDE`` before it.
_HOUSE = re.compile(r"(?<!\d)\d{1,5}(?!\d)")
_INSIDE = re.compile(r"[\w.,\-/:#]")
#: Street names of a preposition and capitalised words, and of two words.
AM_STREET = re.compile(r"(?<![\w\-])(?:(?:A[mM]|I[mM]|A[nN] D[eE][rRnN]|An der|An den|Z[uU][mM]|Z[uU][rR]|Auf de[rm]|In der|Unter den) (?:[A-ZÄÖÜ][\wäöüß\-]+ ?){1,3}|[A-ZÄÖÜ][\wäöüß\-]+er (?:Straße|Str\.|Weg|Platz|Gasse|Allee) ?)(?<= )\d{1,4}(?!\d)(?: ?[a-z]\b)?(?:, \d{5} [A-ZÄÖÜ][\wäöüß\-]+)?")
#: A number and capitalised words without a street word: only a pattern can make it an address.
MAYBE_STREET = re.compile(r"(?<![\w.,\-/:])\d{1,5} [A-ZÀ-Ý][\wà-ÿ'\-]+(?: [A-ZÀ-Ý][\wà-ÿ'\-]+){0,2}")
_CAP = r"[A-ZÀ-Ý][a-zà-ÿ'ß]+"
_SUR = rf"(?:(?:van|von|de|del|della|du|le|la|zu|mac|mc|o') ?)*{_CAP}(?:-{_CAP})*"
PAIR = re.compile(rf"(?=(?<![\w@\-.])({_CAP}(?:-{_CAP})?) ({_SUR}|[A-ZÀ-Ý]\.)(?![\w@]))")
TITLED = re.compile(rf"(?<!\w){TITLE}\.? ({_CAP}(?:-{_CAP})*)(?: {_SUR})?", 0)
TURNED = re.compile(rf"(?<![\w@])([A-ZÀ-Ý][A-ZÀ-Ýa-zà-ÿ'\-]+), ({_CAP})(?!\w)")
ANYCASE = re.compile(r"(?<![\w@.\-])([a-zà-ÿ]{3,12})(?:,? )([a-zà-ÿ][a-zà-ÿ'\-]{2,24}|[a-z]\.)(?![\w@])", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
#: What no pattern reaches across.
_STOP = re.compile(r"[.!?:]+\s|\n")
_LETTERS = re.compile(r"[^\W\d_]+")
_GIVEN = re.compile(r"(?<![\w@.\-])[^\W\d_]{3,12}(?=,? )")
#: End of a sentence; a short word before the point is an abbreviation.
_END = re.compile(r"(?<=\w{4})[.!?]+\s|\n")
_DIGIT, _UPPER = re.compile(r"\d"), re.compile(r"[A-Za-z]")
COMMON_NEXT = frozenset("and or is was the a to in of for on at with who said says et est und ist sagt y es le la el les der die das il il's has had told wrote will would from by as but so because dit dice dot".split())


def _shape(s: str) -> str:
    return re.sub(r"\s*(?:ext|x|poste|durchwahl|extensión)\.?\s?\d+$", "", s.lower()) if len(s) > 12 else s.lower()


class Places:
    """Ordered, merged spans."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.ends, a + 1)
        return i == len(self.ends) or self.starts[i] >= b

    def take(self, a: int, b: int) -> None:
        i, j = bisect_left(self.ends, a + 1), bisect_left(self.starts, b)
        if i < j:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]


class Words:
    """Words of a text by place."""

    def __init__(self, text: str) -> None:
        self.text = text
        found = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [x for x, _ in found], [y for _, y in found]

    def before(self, a: int, n: int) -> int:
        """Start of the ``n``-th word before a place."""
        i = bisect_left(self.starts, a)
        return self.starts[max(0, i - n)] if i else 0

    def after(self, b: int, n: int) -> int:
        """End of the ``n``-th word after a place."""
        i = bisect_left(self.starts, b)
        return self.ends[min(len(self.ends), i + n) - 1] if i < len(self.ends) else len(self.text)

    def around(self, a: int, b: int) -> tuple[str, str]:
        """The patterns left and right of a span: two words of the same sentence."""
        i, j = bisect_left(self.ends, a + 1), bisect_left(self.starts, b)
        f = lambda part: " ".join("0" if x.isdigit() else x.lower() for x in part)
        left = _WORD.findall(_STOP.split(self.text[self.starts[max(0, i - 2)] : a])[-1]) if i else []
        right = _WORD.findall(_STOP.split(self.text[b : self.ends[min(len(self.ends), j + 2) - 1]])[0]) if j < len(self.ends) else []
        return ("L " + f(left[-2:])) if left else "", ("R " + f(right[:2])) if right else ""


def candidates(text: str) -> list[tuple]:
    """``start, end, form, first, second, left, right, seed`` of every candidate; ``seed`` names the kind the form is certain of, or ``none``."""
    out: list[tuple] = []
    taken, names = Places(), Places()
    words = Words(text)
    free, apart = taken.free, names.free

    def add(a: int, b: int, form: str, first: str, second: str, seed: str) -> None:
        left, right = words.around(a, b)
        out.append((a, b, form, first, second, left, right, seed))

    low = text.lower()
    if "@" in text or "at)" in low or "at]" in low or "at}" in low or "at>" in low or (" at " in low and " dot " in low):
        for m in EMAIL.finditer(text):
            s = m.group(0).rstrip(".-_")
            add(m.start(), m.start() + len(s), "email", "email", "", "email")
            taken.take(m.start(), m.end())
    if _DIGIT.search(text):
        before_number = _LAST_WORDS.search(low)
        for h in _HOUSE.finditer(text):
            m = None if h.start() and _INSIDE.match(text, h.start() - 1) else NUMBER_FIRST.match(text, h.start())
            a, b = m.span() if m else (0, 0)
            if m:
                flat = FLAT.search(text, words.before(a, 2), a)
                a = flat.start() if flat else a
            else:
                w, e = words.before(h.start(), 10), words.after(h.end(), 6)
                for rx in (NUMBER_LAST, AM_STREET) if before_number else (AM_STREET,):
                    m = next((x for x in rx.finditer(text, w, e) if x.start() < h.start() < x.end()), None)
                    if m:
                        a, b = m.span()
                        break
            if b > a and free(a, b):
                add(a, b, "street", "street", "", "street_address")
                taken.take(a, b)
        for rx, form in ((CODE, "code"), (NUMBER, "number")):
            for m in rx.finditer(text):
                s = m.group(0)
                start = m.start()
                if s[0] == "(" and ")" not in s[:7]:
                    s, start = s[1:], start + 1
                digits = sum(c.isdigit() for c in s)
                if digits < (6 if form == "code" else 7) or digits > 18 or not free(*m.span()):
                    continue
                core = _shape(s)
                shape = _UPPER.sub("a", _DIGIT.sub("0", core)).replace("(", "").replace(")", "").strip()
                before = [w.lower() for w in _WORD.findall(_END.split(text[words.before(start, 3) : start])[-1])[-3:]]
                seed = ""
                if before and before[-1] in NOT_PERSONAL and not (SAYS_ID | SAYS_PHONE).intersection(before):
                    seed = "none"
                elif re.fullmatch(r"(?:\+\d[\d ().\-/]{7,}|\(0?\d{2,4}\) ?\d[\d \-./]{5,}|1?[\-. ]?\d{3}[\-. ]\d{3}[\-. ]\d{4}|0\d{1,4}[ /\-.]\d[\d \-./]{5,})", core) and not re.fullmatch(r"\d{4}[-./]\d\d?[-./]\d\d?.*|\d\d?[-./]\d\d?[-./]\d{4}", core):
                    seed = "phone"
                elif re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}|[a-z]{2} ?\d\d ?\d\d ?\d\d ?[a-z]", core):
                    seed = "id_number"
                elif re.fullmatch(r"\d{4}[-./]\d\d?[-./]\d\d?.*|\d\d?[-./]\d\d?[-./]\d{4}|(?:978|979)[- ]?\d.*|[\d ]{19,}", core):
                    seed = "none"
                elif SAYS_PHONE.intersection(before):
                    seed = "phone"
                elif SAYS_ID.intersection(before):
                    seed = "id_number"
                add(start, m.end(), form, f"n {shape}", "", seed)
                taken.take(*m.span())
        for m in MAYBE_STREET.finditer(text):
            if free(*m.span()):
                add(m.start(), m.end(), "maybe_street", "maybe_street", "", "")
    for m in TITLED.finditer(text):
        if free(*m.span()) and m.group(1).lower() not in COMMON_NEXT:
            add(m.start(), m.end(), "titled", "title", "s " + m.group(1).lower(), "person_name")
            names.take(*m.span())
    for m in TURNED.finditer(text):
        a, b = m.group(1), m.group(2)
        if free(*m.span()) and (a.isupper() or b.lower() in GIVEN):
            add(m.start(), m.end(), "turned", "g " + b.lower(), "s " + a.lower(), "person_name" if b.lower() in GIVEN else "")
            names.take(*m.span())
    for m in PAIR.finditer(text):
        a, b = m.start(1), m.end(2)
        g, s = m.group(1).lower(), m.group(2).lower()
        if free(a, b) and apart(a, b):
            known = g.split("-")[0] in GIVEN
            add(a, b, "pair", "g " + g, "" if s.endswith(".") else "s " + s, "person_name" if known else "")
            if known:
                names.take(a, b)
    return out


SCHEMA = "record_id bigint, comment_id string, a int, b int, form string, first string, second string, l string, r string, seed string"


def candidate_rows(texts: DataFrame) -> DataFrame:
    """All candidates of all texts; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, list[tuple]] = {}
        for batch in batches:
            rows = []
            for rid, cid, body in zip(batch["record_id"], batch["comment_id"], batch["body"]):
                if body not in memo:
                    if len(memo) > 5_000:
                        memo.clear()
                    memo[body] = candidates(body)
                rows += [(rid, cid, *c) for c in memo[body]]
            if rows:
                yield pd.DataFrame(rows, columns=["record_id", "comment_id", "a", "b", "form", "first", "second", "l", "r", "seed"])

    return texts.select("record_id", "comment_id", "body").mapInPandas(run, SCHEMA)


def no_patterns(cands: DataFrame, kinds: list[str]) -> DataFrame:
    """Patterns before the first turn: none."""
    return cands.sparkSession.createDataFrame([], "p string, " + ", ".join(f"{k} double" for k in kinds))


#: Kinds that a form can be.
OF_FORM = {"email": ["email"], "street": ["street_address"], "maybe_street": ["street_address"], "number": ["phone", "id_number", "none"], "code": ["phone", "id_number", "none"]}


def graph(cands: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of instances (``i``) and patterns (``p``) by kind after ``rounds`` turns over their graph.

    A pattern is worth the share of its instances (surnames apart) that are of a kind, where one of which nothing is known counts little;
    an instance is worth the same share of its different
    left or right patterns, whichever is less, or what its seeds say.
    """
    inst = F.filter(F.array("first", "second"), lambda x: x != "")
    uses = cands.select(F.explode(inst).alias("i"), "l", "r", "seed").groupBy("i", "l", "r", "seed").agg(F.count("*").alias("n"))
    edges = staged(uses, "edges")
    all_kinds = [*KINDS, "none"]
    # what seeds say of instances, and how often each is used
    seeds = edges.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("seed") == k, F.col("n")).otherwise(0)).cast("double").alias(k) for k in all_kinds])
    value = seed_value = staged(seeds.select("i", *[(F.col(k) / (F.col("n") + PRIOR)).alias(k) for k in all_kinds]), "instances")
    score = lambda k: F.when(F.col("seed") == k, 1.0).when(F.col("seed") != "", 0.0).otherwise(F.coalesce(F.col(k), F.lit(0.0)))
    pattern = no_patterns(cands, all_kinds)
    for _ in range(rounds):
        # what is known of a use, at least UNKNOWN
        known = edges.filter("i not like 's %'").join(value, "i", "left").select("i", F.explode(F.filter(F.array("l", "r"), lambda x: x != "")).alias("p"), *[score(k).alias(k) for k in all_kinds])
        # a pattern is judged by the different instances it has, however often each is used
        known = known.groupBy("p", "i").agg(*[F.avg(k).alias(k) for k in all_kinds]).withColumn("weight", F.greatest(F.lit(UNKNOWN), *all_kinds))
        pattern = known.groupBy("p").agg(*[(F.sum(k) / (F.sum("weight") + PRIOR)).alias(k) for k in all_kinds])
        pattern = staged(pattern, "patterns")
        spread = edges.select("i").distinct()
        for c in ("l", "r"):
            of = pattern.select(F.col("p").alias(c), *all_kinds, F.greatest(F.lit(UNKNOWN), *all_kinds).alias("weight"))
            met = edges.filter(F.col(c) != "").select("i", c).distinct().join(of, c).groupBy("i")
            spread = spread.join(met.agg(*[(F.sum(k) / (F.sum("weight") + PRIOR)).alias(f"{c}_{k}") for k in all_kinds]), "i", "left")
        # the worse of the two sides counts; null where a side has no pattern
        spread = spread.select("i", *[F.least(f"l_{k}", f"r_{k}").alias(k) for k in all_kinds])
        new = seed_value.select("i", *[F.col(k).alias(f"s_{k}") for k in all_kinds]).join(spread, "i", "left")
        value = staged(new.select("i", *[F.greatest(F.col(f"s_{k}"), F.coalesce(F.col(k), F.lit(0.0))).alias(k) for k in all_kinds]), "instances")
    return value, pattern


def scored(cands: DataFrame, value: DataFrame, pattern: DataFrame) -> DataFrame:
    """``cands`` plus the best ``kind`` and its ``score``, and ``named``: the score of the first word and of the rest as a person's."""
    all_kinds = [*KINDS, "none"]
    pack = lambda df, key, name: df.select(F.col(key).alias(name), F.array(*all_kinds).alias(f"v_{name}"))
    open_ = cands.filter("seed = ''")
    for key in ("first", "second"):
        open_ = open_.join(pack(value, "i", key), key, "left")
    for key in ("l", "r"):
        open_ = open_.join(pack(pattern, "p", key), key, "left")
    at = lambda name, j: F.coalesce(F.col(f"v_{name}")[j], F.lit(0.0))
    both = [1 - (1 - at("first", j)) * (1 - at("second", j)) * (1 - at("l", j)) * (1 - at("r", j)) for j in range(len(all_kinds))]
    can = lambda k: F.col("form").isin([f for f, ks in OF_FORM.items() if k in ks]) if k != "person_name" else ~F.col("form").isin(list(OF_FORM))
    best = F.array_max(F.array(*[F.struct(F.when(can(k), b).otherwise(0.0).alias("score"), F.lit(k).alias("kind")) for b, k in zip(both, all_kinds)]))
    sure = cands.filter("seed <> ''").withColumn("best", F.struct(F.lit(1.0).alias("score"), F.col("seed").alias("kind")))
    person = KINDS.index("person_name")
    named = F.struct(at("first", person).alias("first"), F.greatest(at("second", person), at("l", person), at("r", person)).alias("rest"))
    cols = ["record_id", "comment_id", "a", "b", "form", "named", "best"]
    sure = sure.withColumn("named", F.struct(F.lit(1.0).alias("first"), F.lit(1.0).alias("rest")))
    return open_.withColumn("best", best).withColumn("named", named).select(*cols).unionByName(sure.select(*cols)).select("record_id", "comment_id", "a", "b", "form", "named", "best.kind", "best.score")


def anycase_rows(texts: DataFrame, value: DataFrame) -> DataFrame:
    """Candidates for names in any case: words that may be one of the given names found so far, and the word after."""
    bits = value.filter((F.col("person_name") >= NAME) & F.col("i").startswith("g ")).select(F.pmod(F.xxhash64("i"), F.lit(NAME_BITS)).alias("b")).distinct()
    names = bytearray(NAME_BITS // 8)
    for r in bits.collect():  # at most NAME_BITS rows
        names[r["b"] >> 3] |= 1 << (r["b"] & 7)
    known = texts.sparkSession.sparkContext.broadcast(bytes(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, bool] = {}

        def maybe(w: str) -> bool:
            if w not in memo:
                if len(memo) > 300_000:
                    memo.clear()
                # the seed is that of Spark's own hash
                h = xxhash.xxh64_intdigest(f"g {w}", 42)
                b = (h - (1 << 64) if h >> 63 else h) % NAME_BITS
                memo[w] = bool(known.value[b >> 3] & (1 << (b & 7)))
            return memo[w]

        for batch in batches:
            rows = []
            for rid, cid, body in zip(batch["record_id"], batch["comment_id"], batch["body"]):
                if not any(map(maybe, set(_LETTERS.findall(body.lower())))):
                    continue
                words = emails = None
                for m in _GIVEN.finditer(body):
                    n = ANYCASE.match(body, m.start()) if maybe(m.group(0).lower()) else None
                    if n is None or n.group(2).lower() in COMMON_NEXT:
                        continue
                    g, s = n.group(1), n.group(2)
                    if not (g.islower() == s.rstrip(".").islower() or s.endswith(".")) or PAIR.match(body, n.start()):
                        continue
                    if words is None:
                        words, emails = Words(body), [e.span() for e in EMAIL.finditer(body)]
                    if all(n.end() <= x or n.start() >= y for x, y in emails):
                        rows.append((rid, cid, n.start(), n.end(), "anycase", "g " + g.lower(), "" if s.endswith(".") else "s " + s.lower(), *words.around(*n.span()), ""))
            if rows:
                yield pd.DataFrame(rows, columns=["record_id", "comment_id", "a", "b", "form", "first", "second", "l", "r", "seed"])

    return texts.select("record_id", "comment_id", "body").mapInPandas(run, SCHEMA)


def spans(records: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Accepted spans: ``record_id, comment_id, a, b, kind, score``. Names in any case are looked for once the graph knows the given names."""
    texts = record_texts(records)
    cands = staged(candidate_rows(texts), "candidates")
    value, pattern = graph(cands, rounds)
    got = scored(cands, value, pattern).filter((F.col("score") >= ACCEPT) & (F.col("kind") != "none") & ((F.col("kind") != "person_name") | (F.col("named.first") >= GIVEN_LEAST)))
    more = scored(anycase_rows(texts, value), value, pattern).filter((F.col("named.first") >= NAME) & ((F.col("named.rest") >= NEAR) | (F.col("named.first") >= SURE))).withColumn("kind", F.lit("person_name"))
    return got.unionByName(more).drop("named", "form")


def found(records: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Cases: distinct ``record_id, comment_id, kind``."""
    return spans(records, rounds).select("record_id", "comment_id", "kind").distinct()


def redact(body: str, marks: list) -> str:
    """``body`` with each span replaced by its placeholder; of overlapping spans the longer stays."""
    chosen: list[tuple[int, int, str]] = []
    for a, b, kind in sorted({(m["a"], m["b"], m["kind"]) for m in marks}, key=lambda m: (m[0] - m[1], m)):
        if all(b <= x or a >= y for x, y, _ in chosen):
            chosen.append((a, b, kind))
    for a, b, kind in sorted(chosen, reverse=True):
        body = body[:a] + PLACEHOLDER[kind] + body[b:]
    return body


def redacted(records: DataFrame) -> DataFrame:
    """Every distinct text: ``record_id, comment_id, redacted, n_spans``."""
    marks = spans(records).groupBy("record_id", "comment_id").agg(F.collect_set(F.struct("a", "b", "kind")).alias("marks"))
    texts = record_texts(records).dropDuplicates(["record_id", "comment_id"])

    @F.pandas_udf("string")
    def run(body: pd.Series, found_: pd.Series) -> pd.Series:
        return pd.Series([t if m is None or len(m) == 0 else redact(t, list(m)) for t, m in zip(body, found_)])

    joined = texts.join(marks, ["record_id", "comment_id"], "left")
    return joined.select("record_id", "comment_id", F.when(F.col("marks").isNull(), F.col("body")).otherwise(run("body", "marks")).alias("redacted"), F.coalesce(F.size("marks"), F.lit(0)).alias("n_spans"))

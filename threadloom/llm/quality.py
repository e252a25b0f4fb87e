"""Problem 8: per-document text quality statistics.

Statistics are taken of every document and of every block of it (text between blank lines).
A Gaussian mixture is fitted to the standardized block statistics by expectation-maximization
over *all* blocks until its likelihood stays; inspected examples of prose, lists, tables and
junk, which had no part in the fit, then say which kind a component is. A document is a case
when blocks of list, table or junk hold more than half of its characters. Nothing depends on
the number of blocks: a table and many copies of it give the same cases.

Each EM round reads the stored block table once, reduces every partition to sufficient
statistics, sums them in Spark, and brings one number per component and statistic to the driver.

Defined results: null and blank texts have statistics of zero and are no cases; whole texts are
read; equal documents get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import staged

#: Components of the mixture: about eight for each kind.
COMPONENTS = 32
#: Distinct block statistics from which the components start, and the starts tried on them.
SAMPLE, STARTS = 4096, 12
#: EM ends when a round raises the mean log-likelihood of a block by less than this share.
TOLERANCE, MOST_ROUNDS = 1e-4, 100
#: Least variance of a standardized statistic within a component.
FLOOR = 0.05
FEATURES = ["words", "word_length", "symbols", "digits", "ended", "common", "marked", "columns", "line_words", "repeated", "odd", "commas", "urls", "longest"]

# Inspected examples, several of each kind.
EXAMPLES = {
    "prose": [
        "The council voted on the new budget last night, and most of the members said that they would rather wait for the report. I think it was the right thing to do.",
        "Has anyone checked whether the company still owns the land near the river?",
        "i went to the meeting and it was just like the last time nobody knew what the plan was or who would pay for it",
        "THE TRAINS RUN AGAIN AND I SAY THIS AS SOMEBODY WHO HAS TO TAKE ONE EVERY DAY, WHICH IS NOT WHAT THEY PROMISED.",
        "Der Rat hat gestern über den Haushalt gesprochen, und die meisten wollten auf den Bericht warten. Das ist für mich nicht neu, aber es wird nicht besser.",
        "Bei uns plant die Gemeinde den Umbau der Schule nach langem Streit, und die Nachbarn merken es.",
        "Le conseil a voté le budget hier soir, mais la plupart des élus voulaient attendre le rapport. Je ne suis pas sûr que ce soit une bonne idée pour la ville.",
        "Il paraît que la société vend le terrain du dépôt pour la troisième fois, et personne ne réagit.",
        "El consejo votó el presupuesto anoche, pero la mayoría quería esperar el informe. No sé si es una buena idea para la ciudad, y los vecinos lo saben.",
        "Según el informe, la empresa vende el solar por tercera vez, así que espero noticias.",
        "quiet-river-123: I would not trust the numbers on the last page, but the chart looks good. To be fair, it is only a draft.",
        "Who said so? I did not see it in the article, and the comments here do not help.\nBut if you can find it, please post the link. We have all been asking for it since last year.",
        "Exactly my thought.",
        "Thanks, that helps.",
        "The meeting ran long, so I left before the vote 🙂",
        "anyone know why the bus was late again today it seems to happen every week and nobody from the company says why 🙂",
        "so the plan is to wait? i would not, because by the time they answer we have paid for it twice, and that is what they want",
        "hier soir le conseil a encore parlé du budget mais personne n'a compris ce qui va changer pour nous",
        "gestern hat der rat wieder über den haushalt gesprochen aber keiner weiß was das für uns heißt",
        "ayer el consejo habló otra vez del presupuesto pero nadie sabe qué cambia para nosotros",
    ],
    "list": [
        "- wage floor\n- night train\n- bus depot\n- hiring freeze\n- old reservoir",
        "* milk\n* bread\n* a dozen eggs\n* some paper towels",
        "• forest road (Westham)\n• census form\n• rent register\n• court transcript (Eastby)",
        "1. privacy rules\n2. data centre\n3. land swap\n4. drought plan\n5. rent register\n6. bike lanes",
        "1) la reforma escolar\n2) el puente viejo\n3) la lista de donantes",
        "(a) visa backlog;",
        "(b) museum roof;",
        "[ ] polling average\n[x] pier renovation\n[ ] postal vote",
        "night train\nold reservoir\ntariff schedule\npolling average\ndata centre\nharbour tunnel",
        "8:00 wage floor\n8:20 flood barrier\n9:00 polling average\n9:20 forest road",
        "Westham: census form\nEastby: night train\nNorthgate: postal vote",
        "pier renovation, census form, battery plant, satellite tender, forest road, night train, bike lanes, flood barrier, tram extension.",
        "wage floor, hiring freeze, postal vote, old reservoir",
        "das Rathaus, den neuen Fahrplan, die alte Brücke, das Bad am Park, die Karte der Stadt",
        "la salle des fêtes, le vieux pont, la liste des salles, le plan du parc, l'horaire du bus",
        "la sala de actos, el puente viejo, la lista de salas, el plan del parque, el horario del bus",
        "Westham: el puente viejo\nEastby: la lista de salas\nNorthgate: el parque",
        "le vieux pont\nla salle des fêtes\nle plan du parc\nl'horaire du bus\nla liste des salles",
    ],
    "table": [
        "| town | homes | pct |\n|---|---:|---|\n| Westham | 2412 | 91.4 |\n| Eastby | 612 | 14.0 |",
        "town\thomes\tpct\tdone\nWestham\t2412\t91.4\tyes\nEastby\t612\t14.0\tno",
        "town;homes;pct;done\nWestham;2412;91.4;yes\nEastby;612;14.0;n/a",
        '"town","homes","pct"\n"Westham","2412","91.4"\n"Eastby","612","14.0"',
        "town        homes   pct  done\nWestham      2412  91.4  yes\nEastby        612  14.0  n/a",
        "town,homes,pct,done\nWestham,2412,91.4,yes\nEastby,612,14.0,no",
        "<tr><td>Westham</td><td>2412</td><td>91.4</td></tr>\n<tr><td>Eastby</td><td>612</td><td>14.0</td></tr>",
    ],
    "junk": [
        "%;[{ }]=+ <*&^ |\\/ ~~ $#@ !{} ;:[ <>_ ^^ *& %$ {[ |;",
        "😂🔥💯👏😂🔥🔥💯👏❗🚲❗😂🔥💯",
        "8421 3 90211 77 5 120031 4 88 9 310 22 7 65012 41 8 903",
        "hhjs jwca lsxtfrtcf srhwsj gvgdq dqzqxq vwlfwlx ljqsj vghxfl hwc xkqrztr",
        "2BzQaNRhQ9OBs+byIZgJcIC0Ybrklv9aAOpyPUt8+tvnYFZtlJxRbZBlWuMDgkplyWIsE2k72Sz7dXmMv2DzkGhIYyvR/uNr96bxPz==",
        "vote now vote now vote now vote now vote now vote now vote now vote now vote now vote now",
        "lol lol lol lol lol lol lol lol lol lol lol lol lol lol",
        "Ã¼Ã¤3 Ã©Ã¨5 Å¾Å¡9 ï¿½ï¿½5 Â§Â°6 Ã¼Ã¤2 â€™â€œ7 Ã©Ã¨4 Å¾Å¡6",
        "+1 +1 +1 +1 +1 +1 +1 +1 +1 +1 +1 +1",
        "Home | Menu | Login | Next » | RSS | Help | « Prev | Print | Top | FAQ | Register | Share | Page 6 | Menu | Home",
        "https://forum.example/kettle/0072947?ref=163\nhttps://forum.example/island/3454434?ref=123\nhttps://forum.example/anchor/2833494?ref=792",
        "https://forum.example/kettle/0072947?ref=163",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
        "========================================",
    ],
}

_TOKEN = re.compile(r"[^\W_]+")
_MARK = re.compile(r"\s*(?:[-*•‣◦+–]\s|\d{1,3}[.)]\s|\(?(?:[a-z]|[ivx]{1,4}|\d{1,3})\)\s|\[[ xX]?\]|\d{1,2}[:.]\d\d\s)", re.I)
_COLUMNS = re.compile(r"(?:[^|\n]*\|){2}|(?:[^;\n]*;){2}|(?:[^\t\n]*\t){2}|(?:.*?\S {2,}(?=\S)){2}|\"[^\"\n]*\",\"|(?:[^\s,]+,){2,}[^\s,]+$")
_ODD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}|^[bcdfghjklmnpqrstvwxz]{3,}$")
_URL = re.compile(r"https?://\S+")
_BLANK = re.compile(r"\n\s*\n")
_ENDS = (".", "!", "?", "…", '."', '!"', '?"', ".)", ":", ".'", ".*", ".**")


def statistics(text: str, common: frozenset[str]) -> list[float]:
    """The statistics of ``FEATURES`` for a document or a block."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    tokens = _TOKEN.findall(text)
    words = [t.lower() for t in tokens if not t[0].isdigit()]
    n, m = len(words), len(lines) or 1
    solid = len("".join(text.split())) or 1
    alnum = sum(map(len, tokens))
    letters = sum(map(len, words))
    count = Counter(words)
    short = sum(c for w, c in count.items() if 3 <= len(w) <= 30)
    return [
        np.log1p(n),
        min(letters / n, 25.0) if n else 0.0,
        1 - alnum / solid,
        (alnum - letters) / solid,
        sum(x.rstrip().endswith(_ENDS) for x in lines) / m,
        sum(c for w, c in count.items() if w in common) / n if n else 0.0,
        sum(_MARK.match(x) is not None for x in lines if not x[0].isalpha() or ")" in x[:6]) / m,
        sum(_COLUMNS.match(x) is not None for x in lines if "|" in x or ";" in x or "," in x or "\t" in x or "  " in x) / m,
        np.log1p(n / m),
        max(count.values()) / n if n else 0.0,
        sum(c for w, c in count.items() if 3 <= len(w) <= 30 and _ODD.search(w)) / short if short else 0.0,
        min(text.count(",") / n, 1.0) if n else 0.0,
        sum(map(len, _URL.findall(text))) / len(text) if "http" in text else 0.0,
        np.log1p(max(map(len, tokens), default=0)),
    ]


def blocks(text: str) -> list[str]:
    return [b for b in _BLANK.split(text) if b and not b.isspace()]


def common_set(common: DataFrame) -> frozenset[str]:
    # a fixed table of function words
    return frozenset(r["word"].lower() for r in common.select("word").collect())


def document_stats(documents: DataFrame, common: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_chars, word_count, mean_word_length, symbol_ratio, digit_ratio, punctuated_lines, common_share`` and the rest of ``FEATURES``."""
    words = documents.sparkSession.sparkContext.broadcast(common_set(common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [statistics(t, words.value) if t else [0.0] * len(FEATURES) for t in b["text"]]
            x = np.array(rows, dtype=float).reshape(-1, len(FEATURES))
            out = pd.DataFrame({"doc_id": b["doc_id"], "n_chars": [len(t) if t else 0 for t in b["text"]], "word_count": np.rint(np.expm1(x[:, 0])).astype("int64")})
            for name, j in (("mean_word_length", 1), ("symbol_ratio", 2), ("digit_ratio", 3), ("punctuated_lines", 4), ("common_share", 5), ("marked_lines", 6), ("column_lines", 7), ("repeated_share", 9)):
                out[name] = x[:, j]
            yield out

    schema = "doc_id bigint, n_chars bigint, word_count bigint, mean_word_length double, symbol_ratio double, digit_ratio double, punctuated_lines double, common_share double, marked_lines double, column_lines double, repeated_share double"
    return documents.select("doc_id", "text").mapInPandas(run, schema)


def block_table(documents: DataFrame, words) -> DataFrame:
    """``doc_id, chars`` and the statistics ``FEATURES`` of every block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, chars, x = [], [], []
            for i, t in zip(b["doc_id"], b["text"]):
                for k in blocks(t) if t else ():
                    ids.append(i)
                    chars.append(len(k))
                    x.append(statistics(k, words.value))
            if ids:
                yield pd.concat([pd.DataFrame({"doc_id": ids, "chars": chars}), pd.DataFrame(np.array(x, dtype=np.float32), columns=FEATURES)], axis=1)

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, chars bigint, " + ", ".join(f"{f} float" for f in FEATURES))


class Mixture:
    """Gaussian mixture with diagonal covariances over standardized statistics."""

    def __init__(self, mean, scale, weights, mu, var):
        self.mean, self.scale, self.weights, self.mu, self.var = mean, scale, weights, mu, var
        self.kinds = np.zeros((len(weights), len(EXAMPLES)))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        inv = 1 / self.var
        quad = (z**2) @ inv.T - 2 * z @ (self.mu * inv).T + ((self.mu**2) * inv).sum(axis=1)
        return np.log(self.weights) - 0.5 * (quad + np.log(2 * np.pi * self.var).sum(axis=1))

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Share of every component in every row, and the log-likelihood of the rows."""
        d = self.log_density(x)
        most = d.max(axis=1, keepdims=True)
        p = np.exp(d - most)
        total = p.sum(axis=1, keepdims=True)
        return p / total, float((most + np.log(total)).sum())

    def sums(self, x: np.ndarray) -> np.ndarray:
        """What EM needs of rows: their number, log-likelihood, and per component the weight, sum and sum of squares."""
        r, fit = self.responsibilities(x)
        z = (x - self.mean) / self.scale
        return np.concatenate([[len(x), fit], r.sum(axis=0), (r.T @ z).ravel(), (r.T @ z**2).ravel()])

    def moved(self, sums: np.ndarray) -> Mixture:
        """The mixture after the maximization step. Only shares of the sums count, so a table and its copies give the same."""
        k, d = self.mu.shape
        n = sums[2 : 2 + k] + 1e-9
        mu = sums[2 + k : 2 + k + k * d].reshape(k, d) / n[:, None]
        var = sums[2 + k + k * d :].reshape(k, d) / n[:, None] - mu**2
        return Mixture(self.mean, self.scale, np.maximum(n / n.sum(), 1e-9), mu, np.maximum(var, 0) + FLOOR)

    def climbed(self, gather, rounds: int) -> tuple[Mixture, float]:
        """EM until the mean log-likelihood stays; ``gather(mixture)`` sums over the rows."""
        model, last = self, -np.inf
        for _ in range(rounds):
            s = gather(model)
            fit = s[1] / max(s[0], 1.0)
            if fit - last <= TOLERANCE * abs(fit):
                break
            model, last = model.moved(s), fit
        return model, last

    def name(self, examples: np.ndarray, kinds: list[str]) -> None:
        """Give every component the shares of the kinds: the nearer an inspected example of a kind, the more."""
        z = (examples - self.mean) / self.scale
        far = (((z[None] - self.mu[:, None]) ** 2) / (self.var[:, None] + 1)).mean(axis=2)
        near = np.stack([far[:, [k == kind for k in kinds]].min(axis=1) for kind in sorted(EXAMPLES)], axis=1)
        p = np.exp(-8 * (near - near.min(axis=1, keepdims=True)))
        self.kinds = p / p.sum(axis=1, keepdims=True)


def _summed(table: DataFrame, stats, size: int) -> np.ndarray:
    """Sum over the table of ``stats(matrix)``, a vector of ``size`` numbers; partitions are reduced where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += stats(b.to_numpy(dtype=float))
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    rows = table.select(*FEATURES).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def start_points(table: DataFrame) -> np.ndarray:
    """At most ``SAMPLE`` distinct block statistics, those of least hash: copies of a block change nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(columns=[*FEATURES, "h"])
        for b in batches:
            h = pd.util.hash_pandas_object(b, index=False).to_numpy().view(np.int64)
            some = np.argsort(h, kind="stable") if len(h) <= SAMPLE else np.argpartition(h, SAMPLE)
            kept = pd.concat([kept, b.assign(h=h).iloc[some]] if len(kept) else [b.assign(h=h)]).drop_duplicates("h").nsmallest(SAMPLE, "h")
        if len(kept):
            yield kept.astype({"h": "int64"})

    each = table.select(*FEATURES).mapInPandas(run, ", ".join(f"{f} float" for f in FEATURES) + ", h bigint")
    return each.dropDuplicates(["h"]).orderBy("h").limit(SAMPLE).select(*FEATURES).toPandas().to_numpy(dtype=float)


def fit(table: DataFrame, common: frozenset[str], rounds: int = MOST_ROUNDS, components: int = COMPONENTS, seed: int = 0) -> Mixture:
    """EM over all blocks until it converges.

    The components start at spread points of a bounded sample (several starts climb on the sample, the
    likeliest goes on over all blocks); the inspected examples only name what was fitted.
    """
    d = len(FEATURES)
    first = _summed(table, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]), 1 + 2 * d)
    n = max(first[0], 1.0)
    mean = first[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(first[1 + d :] / n - mean**2, 1e-4))
    named = [(kind, np.array(statistics(e, common))) for kind, es in EXAMPLES.items() for e in es]
    points = start_points(table)
    if not len(points):
        points = np.stack([x for _, x in named])
    z = (points - mean) / scale
    random = np.random.default_rng(seed)
    k = min(components, len(z))
    best: tuple[float, Mixture] | None = None
    for _ in range(STARTS):
        at = [int(random.integers(len(z)))]
        gap = ((z - z[at[0]]) ** 2).sum(axis=1)
        while len(at) < k and gap.sum() > 0:
            at.append(int(random.choice(len(z), p=gap / gap.sum())))
            gap = np.minimum(gap, ((z - z[at[-1]]) ** 2).sum(axis=1))
        begun = Mixture(mean, scale, np.full(len(at), 1 / len(at)), z[at], np.full((len(at), d), 0.5))
        model, likely = begun.climbed(lambda m: m.sums(points), rounds)
        if best is None or likely > best[0]:
            best = (likely, model)
    model = best[1]
    size = 2 + len(model.weights) * (1 + 2 * d)
    model, _ = model.climbed(lambda m: _summed(table, m.sums, size), rounds)
    model.name(np.stack([x for _, x in named]), [kind for kind, _ in named])
    return model


def labelled(table: DataFrame, model: Mixture) -> DataFrame:
    """``doc_id, chars, kind`` of every block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = sorted(EXAMPLES)
        for b in batches:
            if len(b):
                p = model.responsibilities(b[FEATURES].to_numpy(dtype=float))[0] @ model.kinds
                yield pd.DataFrame({"doc_id": b["doc_id"], "chars": b["chars"], "kind": [kinds[j] for j in p.argmax(axis=1)]})

    return table.mapInPandas(run, "doc_id bigint, chars bigint, kind string")


def kinds(documents: DataFrame, common: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """Per document with text: ``doc_id, prose, list, table, junk`` as shares of the characters of its blocks."""
    words = common_set(common)
    table = staged(block_table(documents, documents.sparkSession.sparkContext.broadcast(words)), "blocks")
    named = labelled(table, fit(table, words, rounds))
    share = lambda k: (F.sum(F.when(F.col("kind") == k, F.col("chars")).otherwise(0)) / F.sum("chars")).alias(k)
    return named.groupBy("doc_id").agg(*[share(k) for k in ("prose", "list", "table", "junk")])


def found(documents: DataFrame, common: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """Cases: ``doc_id`` of documents with more than half list, table or junk."""
    return kinds(documents, common, rounds).filter("prose < 0.5").select("doc_id").distinct()

"""Problem 1: abusive, hateful or sexual content.

Noisy channel: every text is read as a disguised version of an intended text. The
disguises are look-alike symbols (``1``, ``@``, ``$``), masks (``*``), letters and pieces
set apart by spaces or points, and repeated letters. A character 4-gram model counted over
*all* texts gives the probability of an intended letter sequence; a Viterbi search over the
lattice of readings, without a beam, gives the restored text. A piece of text that shows no
disguise has a lattice with one path, so only disguised pieces are searched, each distinct
piece once per worker. Stars hide every letter, so there the listed words that fit come first.

The restored text is scored by a logistic model over single words, pairs and triples of words
of a moving window, listed insults being one class. Its weights are fitted to the labelled
sentences of ``abuse_rows`` against at most ``BACKGROUND`` distinct sentences of the texts.

Defined results: null and empty texts score 0, and so does a text under ``LEAST``; whole texts
of any length are read; repeated rows score the same.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.abuse_rows import ABUSIVE, HARMLESS
from threadloom.llm.texts import plain, record_texts

#: A text with at least this score is a case.
THRESHOLD = 0.5
#: Scores below this are given as 0.
LEAST = 0.02
#: Distinct sentences of the texts, those of least hash, that stand for ordinary language in the fit.
BACKGROUND = 4000
#: Words of the moving window.
WINDOW = 16
ORDER = 4
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Begins and ends a word in the character model.
EDGE = "^"
SYMBOLS = LETTERS + EDGE
_AT = {c: i for i, c in enumerate(SYMBOLS)}
ACCENTS = str.maketrans({c: b for c in map(chr, range(0xE0, 0x180)) if (b := unicodedata.normalize("NFD", c)[0]) in LETTERS})

# Words that insult whoever they are aimed at, by language.
STRONG = """
idiot moron imbecile halfwit dimwit dipshit dumbfuck dumbass dickhead shithead fuckwit fuckface scumbag bitch bastard wanker prick
asshole arsehole jackass douchebag cunt twat retard slut whore degenerate cretin motherfucker cocksucker tosser bellend nitwit
faggot tranny fucktard shitbag
arschloch vollidiot wichser schlampe hure hurensohn fotze missgeburt drecksau mistkerl dummkopf spast
connard connasse salope salaud enculé pute putain ordure abruti crétin débile bâtard
imbécil gilipollas cabrón cabron puta zorra pendejo mierda maricón subnormal escoria
""".split()
# Words that insult only when said to or of somebody.
WEAK = "clown pig parasite loser toad rat worm maggot trash garbage scum vermin animal creep coward liar weasel moron fool dunce leech dumb stupid worthless pathetic spineless brainless filthy".split()
# Insults of several words.
PHRASES = ["dumb fuck", "piece of shit", "waste of oxygen", "waste of space", "waste of skin", "sack of shit", "son of a bitch", "hijo de puta", "fils de pute"]
# Sexual and violent words that are masked in the same ways.
OTHER = "fuck fucking shit cock dick pussy tits cum nudes naked horny porn ass bullet kill rape stfu gtfo kys".split()
# How single characters stand for letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}

LEET_TABLE = str.maketrans({c: x[0] for c, x in LEET.items()})


def fold(text: str) -> str:
    """Lower case without accents."""
    low = text.lower()
    return low if low.isascii() else low.replace("ß", "ss").translate(ACCENTS)


INSULTS = frozenset(map(fold, STRONG))
SOFT = frozenset(map(fold, WEAK)) - INSULTS
LEXICON = sorted({w for x in (*STRONG, *WEAK, *OTHER, *PHRASES) for w in fold(x).split()})
#: Words that are looked for in pieces.
PIECED = frozenset(fold(w) for w in (*STRONG, *WEAK, *OTHER) if len(w) >= 4)

MASKED = re.compile(r"[a-z01345789@$!|+*€£]{2,}")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_](?:[ .\-_·]{1,4}|\*)){2,}[^\W\d_](?![^\W_])")
#: Pieces of words, and what may stand between the pieces of one word.
PIECE = re.compile(r"(?:[^\W_]|[@$!|+€£])*(?:[^\W_]|[@$€£])")
GAP = re.compile(r"[ .\-_·]{1,4}|\*")
#: Log probability of a separator inside a word, of a space between pieces of several letters, of a letter written twice, of a symbol that stands for itself, and of a missing separator between words, where wider gaps part words and where they do not.
APART, SPACE, TWICE, ODD, CLOSE, CLOSER = -3.0, -7.0, -2.0, -4.0, -6.0, -2.0
#: How much likelier a listed word is than the character model says where somebody set its pieces apart.
COARSE = 2.0
DOUBLED = re.compile(r"([^\W\d_])\1")
REPEATED = re.compile(r"([^\W\d_])\1\1")
NO_STAR = ".,;:?\"'()[]{}<>_~^`-"
#: Marks a token of one letter, which may be part of a spaced word.
SINGLE = "\0"
EDGES = ".,;:?\"'()[]{}<>*_~^`-"


class CharModel:
    """Interpolated character 4-gram model over folded words."""

    def __init__(self, grams: dict[str, float]):
        n = len(SYMBOLS)
        top = np.zeros((n,) * ORDER)
        for g, k in grams.items():
            top[tuple(_AT[c] for c in g)] += k
        p: np.ndarray | None = None
        for order in range(1, ORDER + 1):
            c = top.sum(axis=tuple(range(ORDER - order)))
            p = (c + 0.5) / (c.sum() + 0.5 * n) if p is None else (c + 5 * p) / (c.sum(axis=-1, keepdims=True) + 5)
        self.array = np.log(p)
        self.flat = self.array.ravel().tolist()
        self.begin = (_AT[EDGE] * n + _AT[EDGE]) * n + _AT[EDGE]

    def step(self, ctx: int, c: int) -> tuple[float, int]:
        """Log probability of a symbol and the context after it."""
        n = len(SYMBOLS)
        return self.flat[ctx * n + c], ctx % (n * n) * n + c


def word_grams(word: str) -> list[str]:
    w = EDGE * (ORDER - 1) + word + EDGE
    return [w[i : i + ORDER] for i in range(len(w) - ORDER + 1)]


class Decoder:
    """Viterbi search over the readings of one disguised piece; symbols, masks and gaps cost what the channel says."""

    def __init__(self, grams: dict[str, float]):
        self.model = CharModel(grams)
        self.pieced: dict = {}
        for w in PIECED:
            at = self.pieced
            for c in w:
                at = at.setdefault(c, {})
            at["$"] = w
        self.memo: dict[str, str] = {}
        self.costs: dict[str, float] = {}
        self.begun: dict[str, list[tuple[float, dict, str]]] = {}

    def spelled(self, word: str) -> float:
        """Log probability of a word as the character model spells it; a symbol costs ``ODD``."""
        lp = self.costs.get(word)
        if lp is None:
            if len(self.costs) > 300_000:
                self.costs.clear()
            ctx, lp = self.model.begin, 0.0
            for c in word:
                if c in LETTERS:
                    v, ctx = self.model.step(ctx, _AT[c])
                    lp += v
                else:
                    lp += ODD
            lp += self.model.step(ctx, _AT[EDGE])[0]
            self.costs[word] = lp
        return lp

    @staticmethod
    def walk(states: list[tuple[float, dict, str]], piece: str) -> list[tuple[float, dict, str]]:
        """``(cost, place in the tree of words, last letter)`` after the readings of a piece; a letter may repeat the one before."""
        for c in piece:
            nxt: dict[tuple[int, str], tuple[float, dict, str]] = {}
            for lp, at, last in states:
                for x in LEET.get(c, c):
                    v = lp - (c in LEET)
                    for y in ([(v, at[x], x)] if x in at and x != "$" else []) + ([(v + TWICE, at, x)] if x == last else []):
                        k = (id(y[1]), x)
                        if k not in nxt or nxt[k][0] < y[0]:
                            nxt[k] = y
            states = list(nxt.values())
            if not states:
                break
        return states

    def joined(self, text: str) -> str:
        """Put words together whose pieces stand apart, and undo doubled letters, where that is the more probable reading."""
        pieces = [(m.start(), m.end(), m.group(0)) for m in PIECE.finditer(text)]
        out, done, i = [], 0, 0
        while i < len(pieces):
            first = pieces[i][2]
            states = self.begun.get(first)
            if states is None:
                if len(self.begun) > 300_000:
                    self.begun.clear()
                states = self.begun[first] = self.walk([(0.0, self.pieced, "")], first)
            best, plain_lp, j = (0.0, 0, ""), 0.0, i
            while states:
                plain_lp += self.spelled(pieces[j][2])
                ends = [(lp + COARSE + self.spelled(at["$"]), at["$"]) for lp, at, _ in states if "$" in at]
                if ends and (j > i or DOUBLED.search(first)):
                    lp, w = max(ends)
                    if lp - plain_lp > best[0] and w != first:
                        best = (lp - plain_lp, j, w)
                j += 1
                if j == len(pieces) or not GAP.fullmatch(text, pieces[j - 1][1], pieces[j][0]):
                    break
                gap = SPACE if text[pieces[j - 1][1] : pieces[j][0]].isspace() and len(pieces[j - 1][2]) + len(pieces[j][2]) > 2 else APART
                states = self.walk([(lp + gap, at, "") for lp, at, _ in states], pieces[j][2])
            if best[2]:
                out += [text[done : pieces[i][0]], best[2]]
                done, i = pieces[best[1]][1], best[1]
            i += 1
        return "".join(out) + text[done:] if out else text

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """Readings by position: ``(letters, cost)``; no letters drop a repeated one."""
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(token):
            c = token[i]
            j = i
            while j < len(token) and token[j] == c:
                j += 1
            if c == "*":
                out += [[(LETTERS, -3.3)]] * (j - i)
            elif c in LEET:
                out += [[(LEET[c], -1.0)]] * (j - i)
            elif j - i >= 3:
                out += [[(c, -0.1)], [(c, -0.7), ("", -0.7)]]
            else:
                out += [[(c, 0.0)]] * (j - i)
            i = j
        return out

    def fits(self, token: str) -> str | None:
        """The listed word that a token with stars is likeliest to hide."""
        rx = re.compile("".join("[a-z]" if c == "*" else f"[{LEET[c]}]" if c in LEET else re.escape(c) for c in token))
        return max((w for w in LEXICON if rx.fullmatch(w)), key=self.spelled, default=None)

    def viterbi(self, token: str) -> str:
        """The most probable word; every state is kept."""
        if token.count("*") > 1:
            return self._dense(token)
        states: dict[int, tuple[float, str]] = {self.model.begin: (0.0, "")}
        for options in self.lattice(token):
            nxt: dict[int, tuple[float, str]] = {}
            for ctx, (lp, done) in states.items():
                for letters, cost in options:
                    if not letters:
                        if ctx not in nxt or nxt[ctx][0] < lp + cost:
                            nxt[ctx] = (lp + cost, done)
                    for x in letters:
                        v, k = self.model.step(ctx, _AT[x])
                        v += lp + cost
                        if k not in nxt or nxt[k][0] < v:
                            nxt[k] = (v, done + x)
            states = nxt
        return max((lp + self.model.step(ctx, _AT[EDGE])[0], w) for ctx, (lp, w) in states.items())[1]

    def _dense(self, token: str) -> str:
        """``viterbi`` for tokens with several stars: all contexts at once."""
        n = len(SYMBOLS)
        score = np.full((n, n, n), -np.inf)
        score[(_AT[EDGE],) * 3] = 0.0
        back: list[tuple[np.ndarray, np.ndarray]] = []
        for options in self.lattice(token):
            best, first = np.full((n, n, n), -np.inf), np.zeros((n, n, n), dtype=np.int8)
            for letters, cost in options:
                if not letters:
                    better = score + cost > best
                    best[better], first[better] = score[better] + cost, -1
                for x in letters:
                    each = score + cost + self.model.array[..., _AT[x]]
                    top = each.max(axis=0)
                    better = top > best[..., _AT[x]]
                    best[..., _AT[x]][better] = top[better]
                    first[..., _AT[x]][better] = each.argmax(axis=0)[better]
            back.append((first, best))
            score = best
        at = np.unravel_index((score + self.model.array[..., _AT[EDGE]]).argmax(), score.shape)
        word: list[str] = []
        for first, _ in reversed(back):
            f = int(first[at])
            if f >= 0:
                word.append(SYMBOLS[at[2]])
                at = (f, at[0], at[1])
        return "".join(reversed(word))

    def segment(self, letters: str, close: float = CLOSER) -> str:
        """Most probable words of joined single letters: at every letter the word goes on or a new one begins."""
        states: dict[int, tuple[float, str]] = {self.model.begin: (0.0, "")}
        for x in letters:
            nxt: dict[int, tuple[float, str]] = {}
            for ctx, (lp, done) in states.items():
                v, k = self.model.step(ctx, _AT.get(x, 0))
                w, b = self.model.step(self.model.begin, _AT.get(x, 0))
                for y in ((lp + v, done + x, k), (lp + close + self.model.step(ctx, _AT[EDGE])[0] + w, f"{done} {x}", b)):
                    if y[2] not in nxt or nxt[y[2]][0] < y[0]:
                        nxt[y[2]] = y[:2]
            states = nxt
        return max((lp + self.model.step(ctx, _AT[EDGE])[0], w) for ctx, (lp, w) in states.items())[1].strip()

    def run(self, m: re.Match) -> str:
        """Restore a run of single letters; wider gaps part words."""
        s = m.group(0)
        if s not in self.memo:
            words = [re.sub(r"[\W_]+", "", w) for w in re.split(r"[ ]{2,}|\. \.", s)]
            wide = len(words) > 1 and any(len(w) > 1 for w in words)
            if not wide:
                words = ["".join(words)]
            elif len(words[0]) > 2 and self.spelled(words[0]) < self.spelled(words[0][0]) + self.spelled(words[0][1:]) - CLOSER:
                # the run has taken in a word of one letter before it
                words[:1] = [words[0][0], words[0][1:]]
            self.memo[s] = " ".join(self.segment(w, CLOSE if wide else CLOSER) for w in words if w)
        return self.memo[s]

    def token(self, s: str) -> str | None:
        """Restored token, or None where it shows no disguise."""
        if len(s) == 1:
            return SINGLE if s.isalpha() else None
        if s.isalpha():
            if not REPEATED.search(s):
                return None
            return self.viterbi(s) if set(s) <= set(LETTERS) else None
        if SPACED.search(s):
            return SPACED.sub(self.run, s)
        # stars at the end are a mask unless they also stand in front, where they are emphasis
        core = s.strip(EDGES if s.lstrip(NO_STAR)[:1] == "*" else NO_STAR).rstrip("!+|")
        if len(core) < 2 or core.isalpha() and not REPEATED.search(core):
            return None
        if not (core.isalpha() and set(core) <= set(LETTERS) or MASKED.fullmatch(core) and any(c.isalpha() for c in core)):
            return None
        return s.replace(core, "*" in core and self.fits(core) or self.viterbi(core))

    def restore(self, text: str) -> str:
        """The most probable intended text, folded."""
        t = self.joined(fold(plain(text)))
        memo, changed, runs = self.memo, {}, 0
        for s in set(t.split()):
            if s not in memo:
                if len(memo) > 300_000:
                    memo.clear()
                memo[s] = self.token(s)
            r = memo[s]
            if r is not None:
                if r == SINGLE:
                    runs += 1
                else:
                    changed[s] = r
                    runs += 2 * (SPACED.search(s) is not None)
        if runs > 1:
            t = SPACED.sub(self.run, t)
        if not changed:
            return t
        return re.sub(r"\S+", lambda m: changed.get(m.group(0), m.group(0)), t)


_PHRASE = re.compile(r"\b(?:" + "|".join(fold(x).replace(" ", r"\s+") for x in PHRASES) + r")s?\b")
_TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)?|🖕|<ins>|[.!?]+(?=\s|$)|\n")
_YOU = frozenset("you your you're youre ur u op op's yourself poster du dich dir dein deine tu te toi ton ta eres te tu".split())
_BEING = frozenset("was am i'm felt feel".split())


def kind_of(word: str) -> str:
    """A listed insult, also inflected, by its class; any other word as it is."""
    for w in (word, *(word[: -len(e)] for e in ("s", "es", "e", "en", "er", "in") if word.endswith(e))):
        if w in INSULTS:
            return "<ins>"
        if w in SOFT:
            return "<soft>"
    return word


class Scorer:
    """Logistic model over words, pairs and triples of a window of ``WINDOW`` words."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.kinds: dict[str, str] = {}
        # the most that features ending in a word can add
        best: dict[str, dict[int, float]] = defaultdict(dict)
        #: Weights by last word: of the word, of pairs by the word before, of triples by the two before.
        self.ends: dict[str, list] = {}
        for f, w in weights.items():
            *before, last = f.split(" ")
            n = len(before)
            end = self.ends.setdefault(last, [0.0, {}, {}])
            if n:
                end[n][before[0] if n == 1 else tuple(before)] = w
            else:
                end[0] = w
            if w > 0:
                best[last][n] = max(w, best[last].get(n, 0.0))
        self.cap = {k: sum(v.values()) for k, v in best.items()}
        self.aim = sum(max(weights.get(f, 0.0), 0.0) for f in ("@aim", "@self", "@none"))
        for k in ("<ins>", "<soft>"):
            self.cap[k] = self.cap.get(k, 0.0) + self.aim
        self.need = math.log(LEAST / (1 - LEAST)) - bias

    def tokens(self, text: str) -> list[list[str]]:
        """Sentences as lists of words and classes."""
        out: list[list[str]] = [[]]
        if "piece" in text or "waste" in text or " of " in text or " de " in text or "dumb" in text:
            text = _PHRASE.sub("<ins>", text)
        kinds = self.kinds
        for w in _TOKEN.findall(text):
            if w[0] in ".!?\n":
                if out[-1]:
                    out.append([])
                continue
            k = kinds.get(w)
            if k is None:
                if len(kinds) > 300_000:
                    kinds.clear()
                k = kinds[w] = kind_of(w)
            out[-1].append(k)
        return out

    @staticmethod
    def aimed(words: list[str], i: int) -> str:
        """Whom the insult at place ``i`` is for."""
        before = words[max(0, i - 8) : i]
        if not _YOU.isdisjoint(before) or not _YOU.isdisjoint(words[i + 1 : i + 4]):
            return "@aim"
        return "@self" if "i" in before[-4:] and not _BEING.isdisjoint(before[-4:]) or "i'm" in before[-4:] else "@none"

    @staticmethod
    def features(words: list[str]) -> Iterator[tuple[int, str]]:
        """``(place, feature)``; a feature stands where its last word does."""
        a = b = EDGE
        for i, w in enumerate(words):
            yield i, w
            yield i, f"{b} {w}"
            yield i, f"{a} {b} {w}"
            a, b = b, w
            if w == "<ins>" or w == "<soft>":
                yield i, Scorer.aimed(words, i)

    def logit(self, words: list[str]) -> float:
        """The largest sum over the windows of a sentence."""
        hits: list[tuple[int, float]] = []
        ends, get = self.ends, self.weights.get
        for i, w in enumerate(words):
            if w in ends:
                one, two, three = ends[w]
                v = one
                b = words[i - 1] if i else EDGE
                if b in two:
                    v += two[b]
                if three:
                    v += three.get((words[i - 2] if i > 1 else EDGE, b), 0.0)
                if w == "<ins>" or w == "<soft>":
                    v += get(self.aimed(words, i), 0.0)
                if v:
                    hits.append((i, v))
        best, total, first = 0.0 if len(words) > WINDOW else -math.inf, 0.0, 0
        for i, v in hits:
            while hits[first][0] <= i - WINDOW:
                total -= hits[first][1]
                first += 1
            total += v
            best = max(best, total)
        return (best if hits else 0.0) + self.bias

    def score(self, restored: str) -> float:
        """Score of a restored text: that of its worst sentence."""
        most, cap = -math.inf, self.cap.get
        for words in self.tokens(restored):
            if words and sum(cap(w, 0.0) for w in words) >= self.need:
                most = max(most, self.logit(words))
        p = 1 / (1 + math.exp(-most)) if most > -700 else 0.0
        return p if p >= LEAST else 0.0


def fitted(background: list[str], rounds: int = 300, penalty: float = 0.01) -> Scorer:
    """Fit the weights: the labelled sentences against each other and against ordinary sentences.

    Ordinary sentences that the first fit calls abusive are left out of the next.
    """
    reader = Scorer({}, 0.0)
    read = lambda text: [w for s in reader.tokens(fold(text)) for w in s]
    rows = [(read(t), 1.0, 6.0) for t in ABUSIVE] + [(read(t), 0.0, 2.0) for t in HARMLESS]
    ordinary = [w[i : i + WINDOW] for t in background for w in (read(t),) for i in range(0, len(w), WINDOW)]
    names: dict[str, int] = {}
    for words, _, _ in rows:
        for _, f in Scorer.features(words):
            names.setdefault(f, len(names))
    scorer = Scorer({}, 0.0)
    for _ in range(3):
        usual = [w for w in ordinary if not scorer.weights or scorer.logit(w) < 0]
        # words of which nothing is known are harmless, however few the ordinary sentences
        every = rows + [([], 0.0, 0.3 * len(ABUSIVE))] + [(w, 0.0, 4.0 * len(ABUSIVE) / max(len(usual), 1)) for w in usual]
        found_in = [[names[f] for _, f in Scorer.features(words) if f in names] + [len(names)] for words, _, _ in every]
        at = np.concatenate([np.array(f) for f in found_in])
        sizes = np.array([len(f) for f in found_in])
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        y, share = np.array([r[1] for r in every]), np.array([r[2] for r in every])
        times = lambda w: np.add.reduceat(w[at], first)
        back = lambda r: np.bincount(at, np.repeat(r, sizes), minlength=len(names) + 1)
        # the largest curvature bounds the step
        v = np.ones(len(names) + 1)
        for _ in range(30):
            v = back(share * times(v / np.linalg.norm(v)))
        step = 1 / (0.3 * np.linalg.norm(v) + penalty)
        ridge = np.full(len(v), penalty)
        ridge[-1] = 0.0
        ahead, was = np.zeros(len(v)), np.zeros(len(v))
        for t in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(times(ahead), -30, 30)))
            w = ahead - step * (back(share * (p - y)) + ridge * ahead)
            ahead, was = w + t / (t + 3) * (w - was), w
        scorer = Scorer({f: float(w[i]) for f, i in names.items()}, float(w[-1]))
    return scorer


def char_grams(texts: DataFrame) -> dict[str, float]:
    """Character n-gram counts over every text.

    Words are counted first (partial aggregation keeps one row per distinct word and task),
    n-grams from the distinct words after. At most ``len(SYMBOLS) ** ORDER`` rows (half a
    million short ones) reach the driver, whatever the texts.
    """
    low = F.regexp_replace(F.translate(F.lower("body"), "".join(map(chr, ACCENTS)), "".join(ACCENTS.values())), "ß", "ss")
    words = texts.select(F.explode(F.split(low, "[^a-z]+")).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(EDGE * (ORDER - 1)), "w", F.lit(EDGE))
    grams = (
        words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("g"), "n")
        .groupBy("g")
        .agg(F.sum("n").alias("n"))
    )
    return {r["g"]: float(r["n"]) for r in grams.collect()}


def background(texts: DataFrame, most: int = BACKGROUND) -> list[str]:
    """At most ``most`` distinct sentences, those of least hash; copies of a sentence count once."""
    sentence = F.explode(F.split(F.lower("body"), r"[.!?]+(?:\s|$)|\n+")).alias("s")
    each = texts.select(sentence).filter("length(s) between 10 and 400").select("s", F.xxhash64("s").alias("h"))
    total = each.agg(F.approx_count_distinct("h", 0.05)).first()[0] or 1
    share = min(1.0, 2.0 * most / total)
    few = each.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else each
    return [r["s"] for r in few.groupBy("h").agg(F.min("s").alias("s")).orderBy("h").limit(most).collect()]


def score_texts(texts: DataFrame, grams: dict[str, float], scorer: Scorer | None = None) -> DataFrame:
    """``texts`` (with ``body``) plus ``score`` in [0, 1); no shuffle."""
    spark = texts.sparkSession
    by = scorer or fitted(background(texts))
    model = spark.sparkContext.broadcast((grams, by.weights, by.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counted, weights, bias = model.value
        decoder, judge = Decoder(counted), Scorer(weights, bias)
        for batch in batches:
            yield pd.Series([judge.score(decoder.restore(t)) if t else 0.0 for t in batch], dtype="float64")

    return texts.withColumn("score", score(F.col("body")))


def found(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Cases: distinct ``record_id, comment_id`` whose score reaches ``threshold``."""
    texts = record_texts(records)
    scored = score_texts(texts, char_grams(texts))
    return scored.filter(F.col("score") >= threshold).select("record_id", "comment_id").distinct()


def rates(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Share of cases per subreddit over distinct texts of records: ``subreddit, n_texts, n_cases, rate, mean_score``."""
    texts = record_texts(records, "meta.subreddit")
    scored = score_texts(texts, char_grams(texts)).groupBy("subreddit", "record_id", "comment_id").agg(F.max("score").alias("score"))
    return scored.groupBy("subreddit").agg(
        F.count("*").alias("n_texts"),
        F.sum((F.col("score") >= threshold).cast("bigint")).alias("n_cases"),
        F.avg((F.col("score") >= threshold).cast("double")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )

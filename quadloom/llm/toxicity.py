"""Scores for abusive, hateful or sexual lines: a counterfactually regularised linear classifier.

Texts are cut into cues and folded to an alphabet in which spellings coincide: wrong encodings, accents,
letters replaced by digits or signs, stretched and spaced letters and frequent misreadings. Features are runs
of one to three folded words of a cue; two cues in a row also score together, for lines that are split over
both. A document scores as its worst such window. Labels
are on documents, so training alternates between choosing the windows to blame in positive documents and
fitting a logistic model on windows. Sentences with a term for a group of people are paired with copies that
name another group, and the loss adds the squared difference of their scores: merely naming a group must
not count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many labelled documents, those of the smallest hashes, are used for the fit.
MAX_LABELLED = 20_000
#: Log odds of a window without any suspect run.
BIAS = -2.0
#: A document is flagged from this score.
THRESHOLD = 0.3
#: A run of words is suspect from this logarithm of how unlikely its share of positive documents is by chance.
EVIDENCE = 6.0
#: Terms for groups of people that are exchanged for one another in counterfactual copies, by language. Fixed values.
#: Further ones are learned from the labelled texts (``learned_groups``).
GROUPS = {
    "en": "foreigners immigrants refugees migrants women men jews muslims christians gays lesbians blacks whites gypsies arabs asians",
    "de": "ausländer einwanderer flüchtlinge migranten frauen männer juden muslime christen schwule lesben schwarze weiße zigeuner araber asiaten",
    "es": "extranjeros inmigrantes refugiados migrantes mujeres hombres judíos musulmanes cristianos gays lesbianas negros blancos gitanos árabes asiáticos",
    "fr": "étrangers immigrés réfugiés migrants femmes hommes juifs musulmans chrétiens gays lesbiennes noirs blancs gitans arabes asiatiques",
}
#: Words that abuse or are explicit more often than not, by language. They start with a weight of ``SEED``, too little
#: to flag a line alone, and the labels raise or lower it. Fixed values.
SEEDS = {
    "en": "asshole bastard bitch cocksucker cunt dickhead faggot fuck fucker fucking horny moron motherfucker nipples scum scumbag shit slut tits whore worthless",
    "de": "arsch arschloch dreckig drecksack drecksau fick ficken fotze geile hure hurensohn missgeburt nutte scheißkerl schlampe schwanz titten verpiss verreck wichser",
    "es": "cabrón calientes capullo coño follar follarte gilipollas hijoputa imbécil joder malparido maricón mierda pendejo polla puta puto tetas zorra",
    "fr": "abruti baiser bite connard connasse couilles crève enculé foutre gueule merde nique pédé pute putain salaud salope sucer",
}
SEED = 1.0
_SIGNS = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t"})
#: Letters of other scripts that look like Latin ones. Fixed values.
_ALIKE = dict(zip("авеикмнорстухіѕјαεικνορτυχ", "abeukmhopctyxisjaeikvoptux", strict=True))


def _plain() -> dict[int, str | None]:
    """Lower-case Latin letters for accented ones, look-alikes folded, joiners and soft hyphens dropped."""
    table: dict[int, str | None] = {}
    for c in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(c).lower())[0]
        if base.isascii() and base.isalpha():
            table[c] = base
    table |= {ord(k): v for k, v in _ALIKE.items()} | {ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("ø"): "o", ord("ł"): "l", ord("’"): "'"}
    for c in (*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
        table[c] = None
    return table


_PLAIN = _plain()
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_MOJIBAKE = re.compile(r"[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{1,3}")
_TIMING = re.compile(r"^[^\n]*\d\d:\d\d[^\n]*->[^\n]*$", re.M)
_NUMBER = re.compile(r"^\s*\d+\s*$", re.M)
_MARKUP = re.compile(r"<[^<>\n]*>|\{[\\][^{}\n]*\}")
_SPACED = re.compile(r"(?<![a-z0-9@$!*])(?:[a-z0-9@$*][ ._-]){2,}[a-z0-9@$*](?![a-z0-9@$*])")
_WORD = re.compile(r"[a-z0-9@$!|+*\u20ac]*[a-z*][a-z0-9@$!|+*\u20ac]*|[0-9]+|\x00")


def _plainly(found: re.Match) -> str:
    return found[0].translate(_PLAIN)


def _bytes(c: str) -> bytes:
    try:
        return c.encode("cp1252")
    except UnicodeEncodeError:
        return c.encode("latin-1", "replace")


def _mended(found: re.Match) -> str:
    try:
        return b"".join(_bytes(c) for c in found[0]).decode("utf-8")
    except UnicodeDecodeError:
        return found[0]


def fold_word(word: str) -> str:
    """One spelling for many: signs and digits read as letters, misreadings undone, repeats squeezed."""
    if word.isdigit():
        return "#"
    word = word.rstrip("!|+").translate(_SIGNS) if not word.isalpha() else word
    word = word.replace("rn", "m").replace("vv", "w").replace("li", "h").replace("i", "l")
    out, last = [], ""
    for c in word:
        if c != last:
            out.append(c)
        last = c
    return "".join(out)


class _Memo(dict):
    """Folded words by raw word, of bounded size."""

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        self[word] = folded = word if word == "\x00" else fold_word(word)
        return folded


_folded = _Memo()


def cues(text: str | None) -> list[tuple[str, ...]]:
    """The folded words of each cue of a subtitle text; a text without timings is one cue. Empty cues are left out."""
    if not text:
        return []
    if "\u00c3" in text or "\u00c2" in text or "\u00e2" in text:
        text = _MOJIBAKE.sub(_mended, text)
        if "\u00c3" in text or "\u00c2" in text:
            text = _MOJIBAKE.sub(_mended, text)
    text = text.lower()
    if not text.isascii():
        text = _FOREIGN.sub(_plainly, text)
    if "<" in text or "{" in text:
        text = _MARKUP.sub("", text)
    # timings become the only NUL characters, so that the whole text is cut into words at once
    text = _SPACED.sub(_join, _NUMBER.sub("", _TIMING.sub("\x00", text.replace("\x00", " "))))
    words = list(filter(None, map(_folded.__getitem__, _WORD.findall(text))))  # the memo's strings, so that a word is held once
    ends = [i for i, w in enumerate(words) if w == "\x00"]
    return [tuple(words[a + 1 : b]) for a, b in zip([-1, *ends], [*ends, len(words)], strict=True) if b > a + 1]


def _join(found: re.Match) -> str:
    return re.sub(r"[ ._-]", "", found[0])


def grams(words: tuple[str, ...]) -> set:
    """Runs of one to three words."""
    return {*words, *zip(words, words[1:], strict=False), *zip(words, words[1:], words[2:], strict=False)}


def crossing(a: tuple[str, ...], b: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Runs of two or three words over the border of two cues."""
    return [(*a[-x:], *b[:y]) for x, y in ((1, 1), (2, 1), (1, 2)) if len(a) >= x and len(b) >= y]


def windows(found: list[tuple[str, ...]], suspect) -> set[tuple[str, ...]]:
    """Cues with anything suspect, and pairs of neighbours with something suspect over their border as one."""
    hot = {w for w in found if not suspect.keys().isdisjoint(grams(w))}
    return hot | {a + b for a, b in zip(found, found[1:], strict=False) if any(g in suspect for g in crossing(a, b))}


@dataclass
class Model:
    weights: dict = field(default_factory=dict)
    bias: float = BIAS
    triggers: frozenset = frozenset()
    masked: dict = field(default_factory=dict)

    def unmask(self, word: str) -> str:
        """A word with stars for letters as the heaviest trigger that it can stand for."""
        if word not in self.masked:
            letters = word.replace("*", "")
            shape = re.compile(".*".join(map(re.escape, re.split(r"\*+", word))))
            fits = [t for t in self.triggers if isinstance(t, str) and len(letters) > 1 and self.weights.get(t, 0) > 0 and shape.fullmatch(t)]
            if len(self.masked) > 100_000:
                self.masked.clear()
            self.masked[word] = max(fits, key=lambda t: (self.weights[t], t), default=word)
        return self.masked[word]

    def logit(self, words: tuple[str, ...]) -> float:
        w = self.weights
        return self.bias + sum(w[f] for f in grams(words) if f in w)

    def document(self, text: str | None) -> tuple[float, int]:
        """Probability of the worst window, and the number of windows over one half."""
        found = cues(text)
        if text and "*" in text:
            found = [tuple(self.unmask(x) if "*" in x else x for x in c) for c in found]
        t = self.triggers
        own = {i: self.logit(c) for i, c in enumerate(found) if not t.isdisjoint(c)}
        best, n, w = self.bias, 0, self.weights
        for single in own.values():
            n += single > 0
            best = max(best, single)
        for i in {k for i in own for k in (i - 1, i) if 0 <= k < len(found) - 1}:
            border = sum(w[g] for g in crossing(found[i], found[i + 1]) if g in w)
            if border <= 0 and not (i in own and i + 1 in own):
                continue  # the other cue speaks at most against it
            a, b = (own[k] if k in own else self.logit(found[k]) for k in (i, i + 1))
            pair = a + b - self.bias + border
            n += a <= 0 and b <= 0 and pair > 0
            best = max(best, pair)
        return 1 / (1 + math.exp(-min(max(best, -30), 30))), n


def _group_words() -> list[tuple[str, ...]]:
    return [tuple(dict.fromkeys(fold_word(w.translate(_PLAIN)) for w in words.lower().split())) for words in GROUPS.values()]


def learned_groups(texts: Iterable[list[tuple[str, ...]]], groups: list[tuple[str, ...]], rounds: int = 2) -> list[tuple[str, ...]]:
    """``groups`` with further terms that stand where those known do.

    A slot is the two words before and the two after a word. It is a slot of a language if at least two of its terms
    stand in it; a word joins that stands in at least two such slots and in them at least half of its times.
    """
    cue_times = Counter(w for found in texts for w in found)
    words = Counter()
    for w, n in cue_times.items():
        for x in w:
            words[x] += n

    def places(wanted):
        """(slot, word, times) of the words of cues that have a wanted word."""
        for w, n in cue_times.items():
            if wanted.isdisjoint(w):
                continue
            padded = ("", "", *w, "", "")
            for i, x in enumerate(w):
                yield (*padded[i : i + 2], *padded[i + 3 : i + 5]), x, n

    out = []
    for g in groups:
        known = set(g)
        for _ in range(rounds):
            terms: dict[tuple, set] = {}
            for slot, x, _n in places(known):
                if x in known:
                    terms.setdefault(slot, set()).add(x)
            slots = {slot for slot, own in terms.items() if len(own) >= 2}
            near = {x for slot in slots for x in slot if x}
            inside, kinds = Counter(), {}
            for slot, x, n in places(near) if slots else ():
                if slot in slots:
                    inside[x] += n
                    kinds.setdefault(x, set()).add(slot)
            known |= {x for x, own in kinds.items() if len(own) >= 2 and x != "#" and 2 * inside[x] >= words[x]}
        out.append((*g, *sorted(known - set(g))))
    return out


def _twins(window: tuple[str, ...], groups_of: dict[str, list[tuple[str, ...]]]) -> Iterator[tuple[str, ...]]:
    """The window with each of its terms for a group exchanged for each other one of its language."""
    for i, x in enumerate(window):
        for g in groups_of.get(x, ()):
            for other in g:
                if other != x:
                    yield (*window[:i], other, *window[i + 1 :])


def _seed_words() -> set[str]:
    return {fold_word(w.translate(_PLAIN)) for words in SEEDS.values() for w in words.lower().split()}


def _seeded() -> Model:
    words = _seed_words()
    return Model(dict.fromkeys(words, SEED), BIAS, frozenset(words))


def fit(documents: Iterable[tuple[str | None, int]], penalty: float = 0.1, ridge: float = 0.002, rounds: int = 4, steps: int = 150) -> Model:
    """A model from (text, 0 or 1) pairs. Without labels of both kinds it knows the seed words only.

    ``penalty`` weighs the mean squared difference of the scores of windows and their counterfactual copies.
    """
    docs = [(cues(text), label) for text, label in documents]
    docs = [d for d in docs if d[0]]
    n_pos = sum(label for _, label in docs)
    n_neg = len(docs) - n_pos
    if not n_pos or not n_neg:
        return _seeded()
    share = n_pos / (n_pos + n_neg)
    runs = lambda found: set().union(*map(grams, found), *(crossing(a, b) for a, b in zip(found, found[1:], strict=False)))
    pos = Counter(f for found, label in docs if label for f in runs(found))
    # runs too rare to be suspect even without a negative document are left out; of the others and their words negatives are counted
    least = EVIDENCE / max(-math.log(share) - (1 - share), 1e-9)
    pos = {f: p for f, p in pos.items() if p >= least}
    counted = pos.keys() | {w for f in pos if isinstance(f, tuple) for w in f} | _seed_words()
    neg = Counter()
    for found, label in docs:
        if not label:
            own = set()
            for c in found:
                if not counted.isdisjoint(c):
                    own.update(f for f in grams(c) if f in counted)
            own.update(f for a, b in zip(found, found[1:], strict=False) if a[-1] in counted and b[0] in counted for f in crossing(a, b) if f in counted)
            neg.update(own)
    suspect = {}
    for f, p in pos.items():
        expected = (p + neg[f]) * share
        if p > 2 * expected and p * math.log(p / expected) - (p - expected) >= EVIDENCE:
            suspect[f] = math.log((p + 0.5) / n_pos) - math.log((neg[f] + 0.5) / n_neg)
    seeds = _seed_words()
    suspect |= dict.fromkeys(seeds - suspect.keys(), SEED / 0.3)
    # windows with anything suspect; equal windows of negative documents are counted, not repeated
    benign: Counter = Counter()
    blamed: list[list[tuple[str, ...]]] = []
    for found, label in docs:
        hot = windows(found, suspect)
        if label and hot:
            blamed.append(sorted(hot))
        elif not label:
            benign.update(hot)
    every = list(dict.fromkeys([w for b in blamed for w in b] + list(benign)))
    at = {w: i for i, w in enumerate(every)}
    groups_of: dict[str, list[tuple[str, ...]]] = {}
    for g in learned_groups((found for found, _ in docs), _group_words()):
        for x in g:
            groups_of.setdefault(x, []).append(g)
    twins = [(at[w], t) for w in every for t in dict.fromkeys(_twins(w, groups_of))]
    vocab: dict = {}
    seen = Counter(f for w in every for f in grams(w))

    def row(w: tuple[str, ...], grow: bool) -> list[int]:
        return [vocab.setdefault(f, len(vocab)) if grow else vocab[f] for f in grams(w) if (seen[f] >= 2 and grow) or f in vocab]

    for f in suspect:
        vocab[f] = len(vocab)
    rows = [row(w, True) for w in every] + [row(w, True) for _, w in twins]
    ends = np.cumsum([0, *map(len, rows)])
    cols = np.fromiter((c for r in rows for c in r), dtype=np.int64, count=ends[-1])
    owner = np.repeat(np.arange(len(rows)), np.diff(ends))
    prior = np.zeros(len(vocab))
    prior[: len(suspect)] = [0.3 * min(o, 4.0) for o in suspect.values()]
    mean = np.array([SEED if f in seeds else 0.0 for f in vocab])
    m, base = len(every), np.array([i for i, _ in twins], dtype=np.int64)
    weight, bias = prior.copy(), BIAS
    lists = [np.array([at[w] for w in b]) for b in blamed]
    benign_n = np.zeros(m)
    for w, n in benign.items():
        benign_n[at[w]] = n

    def scores(x: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=x[cols], minlength=len(rows))

    for _ in range(rounds):
        z = scores(weight)[:m] + bias
        positive = np.zeros(m)
        for b in lists:
            s = z[b]
            top = s >= max(s.max() - 0.5, -1.0)  # the worst windows, if there is a bad one at all
            positive[b[top]] += 1
        total = positive + benign_n
        use = total > 0
        target = np.where(use, positive / np.maximum(total, 1), 0)
        mass = np.sqrt(total) * use
        mass /= mass.sum()
        vel, vel2 = np.zeros(len(weight)), np.zeros(len(weight))
        for step in range(1, steps + 1):
            s = scores(weight)
            p = 1 / (1 + np.exp(-np.clip(s[:m] + bias, -30, 30)))
            pull = np.zeros(len(rows))
            pull[:m] = mass * (p - target)
            if len(base):
                apart = penalty * 2 * (s[base] - s[m:]) / len(base)
                pull[m:] -= apart
                np.add.at(pull, base, apart)
            grad = np.bincount(cols, weights=pull[owner], minlength=len(weight)) + ridge / max(n_pos, 50) * (weight - mean)
            vel, vel2 = 0.9 * vel + 0.1 * grad, 0.99 * vel2 + 0.01 * grad**2
            move = 0.1 * (vel / (1 - 0.9**step)) / (np.sqrt(vel2 / (1 - 0.99**step)) + 1e-8)
            weight = weight - move
            weight[: len(suspect)] = np.maximum(weight[: len(suspect)], 0)  # only suspect runs speak for abuse,
            weight[len(suspect) :] = np.minimum(weight[len(suspect) :], 0)  # all others only against it
    names = list(vocab)
    kept = {names[i]: float(weight[i]) for i in np.flatnonzero(np.abs(weight) > 0.02)}
    rare = {(f,) if isinstance(f, str) else f for f, w in kept.items() if w > 0.1}
    return Model(kept, bias, frozenset(min(f, key=lambda x: (neg[x], x)) for f in rare))


def labelled(documents: DataFrame, labels: DataFrame) -> list[tuple[str | None, int]]:
    """(text, majority label) of at most ``MAX_LABELLED`` documents; ties count as positive, null labels not at all."""
    rated = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(F.col("toxic").cast("double")) >= 0.5).cast("int").alias("__label"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "__label").toArrow()
    return sorted(zip(rows["text"].to_pylist(), rows["__label"].to_pylist(), strict=True), key=lambda r: (r[1], r[0]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, source, score, n_windows)`` of every document; null and empty texts score as the bias alone.

    ``source`` is trimmed and in lower case. No shuffle; the model travels as a broadcast variable whose size the
    labelled sample bounds.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select("doc_id", F.lower(F.btrim("source", F.lit(" \t\n\r\x0b\x0c"))).alias("source"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.document(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32())], ["doc_id", "source", "score", "n_windows"])

    kind = dict(documents.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, source string, score double, n_windows int")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(source, n_documents, n_flagged, rate, mean_score)`` per source; null sources are a group."""
    flagged = F.sum((F.col("score") >= threshold).cast("long"))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), flagged.alias("n_flagged"), (flagged / F.count(F.lit(1))).alias("rate"), F.avg("score").alias("mean_score"))

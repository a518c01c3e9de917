"""Abusive, hateful or sexually explicit texts (problem 8): boosted trees over dense features, with isotonic calibration.

A text is brought to words first: the consistent form in lower case without marks and stretching, spaced or dotted letters
joined, signs and digits that stand for letters replaced, repeated letters taken once. What that changed is counted (rates
of obfuscation). The features are densities of small lexicons (insults, sexual words, harm, the second person, groups of
people, neutral uses), how near these stand to each other, densities of phrases of one to four words that the labels show to
be typical, rates of capitals and punctuation, and the length.

Everything fitted comes from at most ``LABELS`` labelled texts (chosen by a hash of the id, if there are more), which the
driver holds: the phrases' weights (for each labelled text from the other folds only), the trees (folds 0 to 3), and the calibration
(fold 4). Copies of a text are in one fold. A text whose labels disagree is not used. Scoring reads every document whole.

Defined results: null and empty texts have score 0; without labels of both kinds every score is 0; repeated rows get equal
scores; columns other than those named are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qissaflow.llm.charform import char_class, skeleton
from qissaflow.llm.scratch import spread

LABELS, FOLDS, THRESHOLD = 12_000, 5, 0.5
#: Phrases of so many labelled texts at least get a weight; it is drawn to 0 as by so many more texts of the usual mixture.
SUPPORT, SHRINK = 3, 3.0
TREES, DEPTH, RATE, BINS, LEAF = 80, 4, 0.15, 32, 4.0

# Small lexicons in the languages of the texts, Arabic also in Latin letters.
LEXICONS = {
    "insult": """كلب كلاب خنزير خنازير حمار حمير سافل سفلة خسيس نذل أنذال وغد أوغاد أوباش حقير تافه قذر أقذر وسخ لئيم غبي أبله معتوه أحمق زنديق ملعون عاهرة قحبة شرموطة زانية
        مزبلة زبالة لعنك أخزاك قبحك تبا بئس اغرب اخرس نعل بصقت
        kalb khanzir hmar 7mar sharmuta sharmouta ahbal ghabi 7ayawan hayawan qahba 3ahira kaleb
        idiot moron swine scum scumbag whore bitch bastard fool stupid worthless filth filthy pig dog rat trash animal loser cunt coward
        connard salaud porc abruti crétin imbécile pute salope ordure enculé chien chienne gueule crève débile bâtard lâche vermine""",
    "sexual": """فرج فرجها ذكره ثدي ثدييها نهديها حلمتيها فخذيها دبر دبرها جامعها ضاجعها ينيكها نكح نكحها وطئها أولج إيلاج عاريين عارية تعرت تجردت شهوة اللذة لذة ثيابها إزارها
        cock cunt fuck fucked fucking breasts thighs naked penis vagina sucked nipples dawn stripped moaned
        cuisses seins baisa baiser nue bite chatte lécha suça déshabilla tétons jouir""",
    "harm": """اقتلوا اقتلوهم أحرقوا أحرقوهم اطردوا اذبحوا أبيدوا سحقها حشرات أنجاس نجس حثالة بهائم لصوص عبيد وباء الطاعون قذرة يلوثوها تزول الدواب رائحتهم يستحقون تتركوا لأدوسن
        hang burn kill vermin wiped exterminate thief thieves dirty animals deserves drive plague die
        brûle brûlez tuez pendez exterminer vermine voleurs chassez sales peste mourir rat""",
    "second": """أنت أنتم إنك يا أمك أبوك أبيك أهلك وجهك رأسك لك عليك inta inti anta ya abuk ummak
        you your yours thou thy tu toi ton ta tes vous votre vos""",
    "group": """آل بني بنو أهل قوم كلهم جميعا منهم فيهم إنهم فهم people all every them they these tribe race les ces tous eux leurs peuple""",
    "neutral": """حيوان دابة يحرس الغنم الماء الحطب المعجم ألفاظ الطبيب أدوية باب الصلاة ستر العورة الشدة الجامع السوق الشاعر مدح بالكرم الثوب غسل أجرة نهى تلاميذه
        lexicon term word note law divorce merchant well slept gate herd medicine poet praise honoured gifts
        lexique mot terme note droit mariage allaitement marchand puits berger médecin éloge honneur cadeaux""",
}
#: Digits and signs that stand for letters inside words of Latin letters.
_LEET = str.maketrans("013457@$", "oieasyas")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_*·•] ?[^\W\d_]){2,}(?![^\W_])|(?<![^\W_])[^\W\d_](?: [^\W\d_]){3,}(?![^\W_])")
_MAYBE_SPACED = re.compile(r"[.\-_*·• ][^\W\d_][.\-_*·• ] ?[^\W\d_](?![^\W_])")
_GLUE = re.compile(r"[.\-_*·•\s]")
_STAR = re.compile(r"[*#!@$_·](?<=[^\W\d_].)(?=[^\W\d_])")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_TWICE = re.compile(r"([^\W_])\1+")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(r"[\u00ad\u061c\u0640\u200b-\u200f\u2060\ufeff](?<=[^\W_].)(?=[^\W_])")
_PREFIX = re.compile(r"^[وف]?(?:بال|كال|لل|ال|[بكل])?(?=..)")
_LATIN_DIGIT = re.compile(r"[a-z]\d|\d[a-z]")
_SIGN = re.compile(r"[.,;:!?،؛؟]")


@lru_cache(1)
def _marks() -> re.Pattern[str]:
    return re.compile(char_class([0x640, *(c for c in range(0x300, 0x1E0F0) if unicodedata.category(chr(c))[0] == "M")]))


def plain_words(text: str) -> tuple[list[str], list[float]]:
    """The words, and how often the text hid something (characters inside words, spaced letters, signs for letters); its
    length, its capitals, words in capitals, punctuation and exclamation marks."""
    hidden = len(_HIDDEN.findall(text))
    form = skeleton(text)
    lower = _marks().sub("", unicodedata.normalize("NFD", form.casefold()))
    spaced = 0
    if _MAYBE_SPACED.search(lower):
        lower, spaced = _SPACED.subn(lambda m: _GLUE.sub("", m[0]), lower)
    lower, signs = _STAR.subn(lambda m: {"@": "a", "$": "s", "!": "i"}.get(m[0], ""), lower)
    capitals = whole = 0
    if form.lower() != form:
        capitals, whole = sum(map(str.isupper, form)), sum(1 for w in form.split() if len(w) > 2 and w.isupper())
    return _WORD.findall(lower), [hidden, spaced, signs, len(form), capitals, whole, len(_SIGN.findall(form)), form.count("!")]


KINDS = list(LEXICONS)


def _same(word: str) -> str:
    """One spelling: repeated letters once, digits among Latin letters as the letters they stand for."""
    word = _TWICE.sub(r"\1", word)
    return word.translate(_LEET) if word[0] < "ɐ" and not word.isdigit() else word


@lru_cache(1)
def _lexicon() -> dict[str, int]:
    out: dict[str, int] = {}
    for k, kind in enumerate(KINDS):
        for term in LEXICONS[kind].split():
            for word in map(_same, plain_words(term)[0]):
                out[word] = out.get(word, 0) | 1 << k
    return out


@lru_cache(1 << 18)
def _word(word: str) -> tuple[int, int]:
    """A 64-bit name of the word, and the lexicons that it is in; further bits if its letters are stretched or mixed with digits."""
    name = _same(word)
    own = _lexicon()
    flags = own.get(name, 0) or own.get(_PREFIX.sub("", name), 0)
    flags |= bool(_STRETCH.search(word)) << len(KINDS) | bool(_LATIN_DIGIT.search(word)) << len(KINDS) + 1
    return int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "little"), flags


U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


class Texts:
    """The words of several texts, one after the other, and the counts of each text."""

    def __init__(self, texts: list[str]):
        found = [plain_words(t) for t in texts]
        flat = [_word(w) for words, _ in found for w in words]
        self.names = np.array([x[0] for x in flat], U)
        self.flags = np.array([x[1] for x in flat], np.int64)
        self.lengths = np.array([len(words) for words, _ in found], np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.lengths)
        self.counts = np.array([c for _, c in found], float).reshape(len(texts), 8)

    def phrases(self) -> list[np.ndarray]:
        """For 1 to 4 words: the name of the phrase that begins at each word; 0 where the text ends before."""
        out, own = [self.names], self.names
        for n in (1, 2, 3):
            longer = np.zeros(len(own), U)
            if len(own) > n:
                longer[:-n] = _mix(own[:-n] * U(0x9E3779B97F4A7C15) + self.names[n:] + U(n))
                longer[:-n][self.text[n:] != self.text[:-n]] = 0
                longer[:-n][own[:-n] == 0] = 0
            out.append(longer)
            own = longer
        return out

    def most(self, value: np.ndarray, least: float = 0.0) -> np.ndarray:
        out = np.full(len(self.lengths), least)
        np.maximum.at(out, self.text, value)
        return out

    def total(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, value, len(self.lengths))

    def near(self, one: np.ndarray, other: np.ndarray, reach: int) -> np.ndarray:
        """Where ``one`` holds and ``other`` within ``reach`` words of it in the same text."""
        hit = np.zeros(len(one), bool)
        for d in range(1, reach + 1):
            if len(one) > d:
                same = self.text[d:] == self.text[:-d]
                hit[d:] |= one[d:] & other[:-d] & same
                hit[:-d] |= one[:-d] & other[d:] & same
        return hit

    def features(self, weights: list[np.ndarray]) -> np.ndarray:
        """``weights``: that of the phrase of 1 to 4 words at each word."""
        n = np.maximum(self.lengths, 1)
        has = {kind: (self.flags >> k & 1).astype(bool) for k, kind in enumerate(KINDS)}
        out = []
        for w in weights:
            out += [self.most(w), -self.most(-w), self.total(w > 1.0)]
        best = np.max(weights, axis=0) if len(self.names) else np.zeros(0)
        for span in (4, 8):
            sums = np.concatenate([[0.0], np.cumsum(best)])
            first = np.concatenate([[0], np.cumsum(self.lengths)])[self.text]
            at = np.arange(len(best))
            out.append(self.most(sums[at + 1] - sums[np.maximum(at + 1 - span, first)]))
        for kind in KINDS:
            out += [self.total(has[kind]), self.total(has[kind]) / n]
        out += [self.total(self.near(has["insult"], has["second"], 3)), self.total(self.near(has["harm"], has["group"], 5)), self.total(self.near(has["sexual"], has["sexual"], 4)), self.total(self.near(has["insult"], has["neutral"], 4)), self.total(self.near(has["sexual"], has["neutral"], 4)), self.total(self.near(has["insult"], has["insult"], 4))]
        out += [self.total(self.flags >> len(KINDS) + k & 1) / n for k in (0, 1)]
        size = np.maximum(self.counts[:, 3], 1)
        out += [self.counts[:, k] / size for k in (0, 1, 2, 4, 5, 6, 7)]
        out.append(np.log1p(self.lengths))
        return np.column_stack(out)


class Trees:
    """Gradient-boosted trees for a yes or no, grown level by level on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(m)]
        self.cuts = [np.unique(np.append(c, np.quantile(x[x[:, k] > 0, k], [0.1, 0.3, 0.5, 0.7, 0.9]))) if (x[:, k] > 0).any() else c for k, c in enumerate(self.cuts)]
        binned = self._bins(x)
        width = max(len(c) for c in self.cuts) + 1
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score = np.full(n, self.base)
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, np.int64)
            tree = []
            for depth in range(DEPTH):
                nodes = 1 << depth
                best = np.full(nodes, 1e-6)
                split = np.zeros((nodes, 2), np.int64)
                split[:, 1] = width
                for k in range(m):
                    at = node * width + binned[:, k]
                    sg = np.bincount(at, g, nodes * width).reshape(nodes, width).cumsum(1)
                    sh = np.bincount(at, h, nodes * width).reshape(nodes, width).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[(sh < LEAF * 0.1) | (th - sh < LEAF * 0.1)] = 0
                    top = gain.argmax(1)
                    value = gain[np.arange(nodes), top]
                    better = value > best
                    best[better] = value[better]
                    split[better, 0], split[better, 1] = k, top[better]
                tree.append(split)
                node = node * 2 + (binned[np.arange(n), split[node, 0]] > split[node, 1])
            leaves = 1 << DEPTH
            leaf = RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            self.trees.append((tree, leaf))
            score += leaf[node]
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)])

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._bins(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for split in tree:
                node = node * 2 + (binned[rows, split[node, 0]] > split[node, 1])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and the share of yes that rises with them (pool adjacent violators), for interpolation."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        pools.append([s, s, v, 1.0])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    xs = np.array([e for p in pools for e in (p[0], p[1])])
    return xs, np.repeat([p[2] / p[3] for p in pools], 2)


class Model:
    """What was learned from labelled texts: phrase weights, trees and calibration."""

    def __init__(self, texts: list[str], labels: list[int]):
        y = np.array(labels, float)
        self.fitted = len(y) > 0 and 0 < y.sum() < len(y)
        if not self.fitted:
            return
        own = Texts(texts)
        fold = (_mix(np.bincount(own.text, (own.names % U(1 << 20)).astype(float), len(texts)).astype(U)) % U(FOLDS)).astype(np.int64)
        prior = y.mean()
        logit = np.log(prior / (1 - prior))
        self.keys, self.weights, learned = [], [], []
        for names in own.phrases():
            some = names != 0
            key, which, often = np.unique(names[some], return_inverse=True, return_counts=True)
            able = (often >= SUPPORT)[which]
            key, which = key[often >= SUPPORT], np.unique(which[able], return_inverse=True)[1]
            kept = np.unique(which * len(texts) + own.text[some][able])
            which, text = np.divmod(kept, len(texts))
            at = which * FOLDS + fold[text]
            count = np.bincount(at, minlength=len(key) * FOLDS).reshape(-1, FOLDS).astype(float)
            yes = np.bincount(at, y[text], len(key) * FOLDS).reshape(-1, FOLDS)
            weight = lambda yes, n: np.where(n >= SUPPORT, np.log((yes + SHRINK * prior) / (n - yes + SHRINK * (1 - prior))) - logit, 0.0)  # noqa: B023, E731
            whole = weight(yes.sum(1), count.sum(1))
            others = weight(yes.sum(1)[:, None] - yes, count.sum(1)[:, None] - count)
            at = np.searchsorted(key, names)
            at[at == len(key)] = 0
            known = key[at] == names if len(key) else np.zeros(len(names), bool)
            learned.append(np.where(known, others[at, fold[own.text]], 0.0) if len(key) else np.zeros(len(names)))
            far = np.abs(whole) > 0.3
            self.keys.append(key[far])
            self.weights.append(whole[far])
        x = own.features(learned)
        fit = fold < FOLDS - 1
        if not (0 < y[fit].sum() < fit.sum() and 0 < y[~fit].sum() < (~fit).sum()):
            fit = np.ones(len(y), bool)
        self.trees = Trees().fit(x[fit], y[fit])
        held = ~fit if not fit.all() else fit
        self.held = (self.trees.score(x[held]), y[held])
        self.calibration = isotonic(*self.held)

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.fitted or not texts:
            return np.zeros(len(texts))
        own = Texts(texts)
        weights = []
        for names, key, weight in zip(own.phrases(), self.keys, self.weights):
            if not len(key):
                weights.append(np.zeros(len(names)))
                continue
            at = np.minimum(np.searchsorted(key, names), len(key) - 1)
            weights.append(np.where(key[at] == names, weight[at], 0.0))
        return np.where(own.lengths > 0, np.interp(self.trees.score(own.features(weights)), *self.calibration), 0.0)


def labelled(documents: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, most: int = LABELS) -> DataFrame:
    """text and label of at most ``most`` labelled documents; those with labels that disagree are left out."""
    one = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.min(label_column).alias("label"), F.max(label_column).alias("other"))
    one = one.where("label = other").orderBy(F.xxhash64("id"), "id").limit(most).select("id", F.col("label").cast("int").alias("label"))
    texts = documents.where(F.col(text_column) != "").select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return texts.join(F.broadcast(one), "id").groupBy("text").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("text", "label")


def scores(documents: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, also: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns ``also`` and the calibrated score of every document."""
    rows = sorted(labelled(documents, labels, id_column, text_column, label_column).collect())
    model = Model([r["text"] for r in rows], [r["label"] for r in rows])
    names = [f"_{k}" for k in range(len(also))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                score = pa.array(model.score([t or "" for t in part.column(1).to_pylist()]), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(2 + k) for k in range(len(also))), score], ["id", *names, "score"])

    plain = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *(F.col(c).alias(n) for c, n in zip(also, names)))
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in ("id", *names)) + ", score double"
    return spread(plain).mapInArrow(run, schema).select(F.col("id").alias(id_column), *(F.col(n).alias(c) for c, n in zip(also, names)), "score")


def abusive(documents: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, threshold: float = THRESHOLD) -> DataFrame:
    return scores(documents, labels, id_column, text_column, label_column).where(F.col("score") >= threshold).select(id_column)


def rates(documents: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, source_column: str, threshold: float = THRESHOLD) -> DataFrame:
    """For each source (null is one of them): its documents, how many are abusive, their share and the mean score."""
    found = scores(documents, labels, id_column, text_column, label_column, (source_column,))
    return found.groupBy(source_column).agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("abusive"), F.avg((F.col("score") >= threshold).cast("int")).alias("rate"), F.avg("score").alias("mean_score"))

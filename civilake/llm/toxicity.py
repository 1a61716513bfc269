"""Toxicity by weak supervision: voters, a generative label model with correlations, and a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilake.llm.langid import held_out
from civilake.llm.sampling import few
from civilake.llm.staging import staged

# The curated lexicons, in English, Spanish, German and French.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers clown clowns dumb imbecile imbeciles fool fools "
    "idiota idiotas imbécil estúpido estúpida tonto tonta idioten dummkopf trottel crétin imbécile débile stupide".split()
)
CONTEMPT = frozenset(
    "scum trash worthless pathetic disgusting vermin garbage filth filthy parasite parasites useless "
    "basura escoria asqueroso asquerosa inútil abschaum widerlich wertlos ungeziefer ordure racaille dégoûtant minable".split()
)
HATRED = frozenset("hate hates despise despises loathe detest odio desprecio hasse hassen verachte déteste hais méprise".split())
PROFANITY = frozenset("damn damned crap bastard bastards bitch asshole mierda cabrón scheiße arschloch merde connard salaud".split())
COURTESY = frozenset("please thanks thank welcome gracias bienvenido bitte danke willkommen merci bienvenue".split())
SILENCING = ("shut up", "get lost", "go away", "nobody wants you", "cállate", "lárgate", "halt die klappe", "verschwinde", "tais-toi", "ferme-la", "dégage")
HARM = ("kill", "hurt", "beat", "break", "destroy", "find", "matar", "bringe dich um", "tuer")
THREATS = re.compile(r"\b(?:i(?:'ll| will)|we(?:'ll| will)|gonna|going to) (?:kill|hurt|beat|break|destroy|find) (?:you|him|her|them)\b|\bte voy a matar\b|\bich bringe dich um\b|\bje vais te tuer\b")
ADDRESSED = re.compile(r"\b(?:you|you're|u|du bist|ihr seid|eres|sois|tu es|vous êtes)\s+(?:[^\W\d_]+\s+){0,2}?([^\W\d_]+)")
SORTS = ("people like you", "your kind", "those people", "leute wie du", "gente como tú", "des gens comme toi")
SWAPPED = re.compile(r"[a-z][a-z@$!|013*]*[@$!|013*][a-z@$!|013*]*")
UNSWAPPED = str.maketrans("@$!|013", "asiioie")
STRETCHED = re.compile(r"([^\W\d_])\1{3}")

#: Most labelled rows of each class that the classifier is fitted on; the lexicons are mined from all.
TOXIC_ROWS, CLEAN_ROWS = 3000, 9000
#: A unit enters a lexicon at this log-likelihood ratio (one in a billion by chance), in that many documents.
LEAST_LLR, LEAST_DOCUMENTS = 37.0, 8
#: Size of the model: units that the lexicons may have (some 10 MB in each task). It is far beyond what passes the two bounds above in prose, and orders by them.
LEXICON_UNITS = 100_000
#: A mined word is a strong sign from this ratio.
STRONG_LLR = 4 * LEAST_LLR
#: Word beginnings of this length are units beside whole words.
PREFIX = 5
#: Voters and what each votes where it does not abstain: 1 toxic, -1 clean.
VOTERS = {
    "insults": 1, "contempt": 1, "hatred": 1, "profanity": 1, "silencing": 1, "threats": 1, "addressed": 1, "sorts_of_people": 1, "swapped_letters": 1,
    "stretched": 1, "shouting": 1, "exclaiming": 1, "mined_word": 1, "mined_strong": 1, "mined_several": 1, "mined_beginning": 1, "courtesy": -1, "no_sign": -1,
}
SIGNS = np.array(list(VOTERS.values()))
#: Voters whose votes correlate more than this, given the label, are modelled jointly, up to so many together.
CORRELATED, CLIQUE = 0.25, 3
WORD = re.compile(r"[^\W\d_]+")
MARKS = re.compile(r"[!?]{3,}")
THRESHOLD = 0.3
#: The classifier's intercept if there is no labelled row to learn from: every score is then 0.018.
NOTHING_LEARNT = -4.0


def units(text: str | None) -> set[str]:
    """The distinct units of a whole text: words, and word beginnings marked with a trailing ``*``."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


def votes(text: str | None, lexicon: dict[str, tuple[int, bool]]) -> tuple[int, list[int]]:
    """Which voters do not abstain, as bits in their order, and the numbers of the lexicon units in the text."""
    text = text or ""
    low = text.lower()
    words = set(WORD.findall(low))
    hits = [lexicon[w] for w in words if w in lexicon]
    starts = [lexicon[u] for u in {w[:PREFIX] + "*" for w in words if len(w) > PREFIX} if u in lexicon]
    curses = INSULTS | CONTEMPT
    insult, contempt = not INSULTS.isdisjoint(words), not CONTEMPT.isdisjoint(words)
    loud = sum(1 for w in set(WORD.findall(text)) if len(w) > 2 and w.isupper()) if not text.islower() else 0
    found = [
        insult,
        contempt,
        not HATRED.isdisjoint(words),
        not PROFANITY.isdisjoint(words),
        any(phrase in low for phrase in SILENCING),
        any(verb in low for verb in HARM) and THREATS.search(low) is not None,
        (insult or contempt) and any(m[1] in curses for m in ADDRESSED.finditer(low)),
        any(phrase in low for phrase in SORTS),
        any(m[0].translate(UNSWAPPED) in curses for m in SWAPPED.finditer(low)) if any(c in low for c in "@$!|013") else False,
        STRETCHED.search(low) is not None,
        loud > 0.3 * len(words) and sum(map(len, words)) > 20,
        MARKS.search(text) is not None,
        bool(hits),
        any(strong for _, strong in hits),
        len(hits) > 1,
        bool(starts),
        not COURTESY.isdisjoint(words),
    ]
    found.append(not any(found[:16]))
    return sum(1 << i for i, bit in enumerate(found) if bit), [at for at, _ in hits + starts]


def voted(masks: np.ndarray) -> np.ndarray:
    """A row of votes (1 toxic, -1 clean, 0 none) for each mask that ``votes`` made."""
    return (np.asarray(masks, np.int64)[:, None] >> np.arange(len(SIGNS)) & 1) * SIGNS


def llr(a: Column, b: Column, n_a: float, n_b: float) -> Column:
    """Log-likelihood ratio of a unit in ``a`` of ``n_a`` toxic and ``b`` of ``n_b`` clean documents, against one common rate."""

    def part(k: Column, n: float, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log1p(-p)).otherwise(0.0)

    p = (a + b) / (n_a + n_b)
    return 2 * (part(a, n_a, a / n_a) + part(b, n_b, b / n_b) - part(a, n_a, p) - part(b, n_b, p))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``at, body`` of the labelled rows outside the held-out quarter, and ``at, h, toxic, weight`` of those that teach.

    Equal texts count once. Texts of one class whose sketches are equal, as
    those of near copies mostly are, weigh one together: else whatever one copied
    text holds would look like a sign of its class. No distinct text is left out.
    Rows with a null label or null id teach nothing; an id or text with several
    labels counts as the largest.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = few(staged(known.where(~held_out(F.col("doc_id"), 4, 2)).select(F.col("doc_id").cast("long").alias("known_id"), "toxic"), "toxicity-known"))
    texts = docs.select("doc_id", F.col("text").alias("body"))
    found = texts.join(known, F.col("doc_id") == F.col("known_id")).select("body", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sketch(text.as_py()) for text in batch.column(0)]
            yield pa.record_batch([*batch.columns, pa.array(keys, pa.int64())], names=["body", "toxic", "sketch"])

    rows = found.mapInArrow(run, "body string, toxic int, sketch long").withColumns({"at": F.monotonically_increasing_id(), "h": F.xxhash64(F.coalesce("body", F.lit("")))})
    rows = staged(rows, "toxicity-labelled")
    once = rows.groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("sketch").alias("sketch"), F.min("at").alias("at"))
    alike = once.groupBy("sketch", "toxic").agg((1.0 / F.count("*")).alias("weight"))
    return rows.select("at", "body"), staged(once.join(alike, ["sketch", "toxic"]).select("at", "h", "toxic", "weight"), "toxicity-once")


def training_sample(rows: DataFrame, once: DataFrame, sizes: dict[int, int], toxic_rows: int, clean_rows: int) -> DataFrame:
    """``body, toxic, weight``: at most so many of the labelled texts of each class, by their hashes."""
    parts = []
    for label, most in {1: toxic_rows, 0: clean_rows}.items():
        share = min(1.0, 1.2 * most / max(sizes.get(label, 0), 1))
        part = once.where((F.col("toxic") == label) & (F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))).orderBy("h").limit(most)
        parts.append(part.select("at", "toxic", "weight"))
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most toxic_rows + clean_rows rows of 20 bytes
    return rows.join(chosen, "at").select("body", "toxic", "weight")


def sketch(text: str | None) -> int:
    """The two smallest hashes of a text's runs of three words: near copies mostly share them, texts that only share a vocabulary do not."""
    words = (text or "").lower().split()
    hashes = sorted({crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))})[:2]
    return hashes[0] << 31 ^ hashes[-1]


def mine_lexicon(texts: DataFrame, n_toxic: float, n_clean: float) -> dict[str, tuple[int, bool]]:
    """Units that tell toxic from clean documents (``body, toxic, weight``) beyond chance, by their weights in all of them; unit to number, and whether it is a strong sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: dict[str, list[float]]) -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.float64()), pa.array([c[0] for c in counts.values()], pa.float64())],
                names=["unit", "toxic", "clean"],
            )

        counts: dict[str, list[float]] = {}
        for batch in batches:
            for text, toxic, weight in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for unit in units(text.as_py()):
                    counts.setdefault(unit, [0.0, 0.0])[toxic == 1] += weight
                if len(counts) >= 1 << 17:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    if not n_toxic or not n_clean:
        return {}
    total = lambda c: F.sum(F.round(c, 6).cast("decimal(28,6)")).cast("double")  # noqa: E731  the same in any order of tasks
    counts = texts.mapInArrow(run, "unit string, toxic double, clean double").groupBy("unit").agg(total("toxic").alias("a"), total("clean").alias("b"))
    likely = counts.where((F.col("a") >= LEAST_DOCUMENTS) & (F.col("a") * n_clean > 4 * F.col("b") * n_toxic))
    likely = likely.withColumn("llr", llr(F.col("a"), F.col("b"), n_toxic, n_clean)).where(F.col("llr") >= LEAST_LLR)
    best = likely.orderBy(F.desc("llr"), "unit").limit(LEXICON_UNITS).select("unit", "llr").collect()
    return {row["unit"]: (i, row["llr"] >= STRONG_LLR) for i, row in enumerate(best)}


class LabelModel:
    """A generative model of the hidden label and the votes, fitted by expectation maximisation to how often each pattern of votes occurs.

    Given the label, cliques of voters are independent of one another; inside a
    clique every combination of votes has a probability of its own. Voters start
    alone; those that turn out to correlate given the label are joined, most
    correlated first, and the model is fitted again. Rows whose label is known
    (``known``, ``labels``) take part with it. ``accuracy`` is each voter's share
    of right votes, ``correlation`` that of its votes with each other's given the
    label, ``cliques`` what was joined.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float, known: np.ndarray | None = None, labels: np.ndarray | None = None, weights: np.ndarray | None = None, rounds: int = 25):
        m = patterns.shape[1]
        known = np.zeros((0, m), int) if known is None else known
        labels = np.zeros(0) if labels is None else labels
        self.prior = float(np.clip(prior, 1e-4, 0.5))
        everything, weight = np.vstack([patterns, known]), np.concatenate([counts, np.ones(len(known)) if weights is None else weights])
        self.cliques = [[j] for j in range(m)]
        post = np.where((patterns == 1).any(1), 0.7, 0.02)
        post = self._fitted(everything, weight, np.concatenate([post, labels]), len(patterns), rounds)
        self.correlation = self._correlations(everything, weight, post)
        self._join()
        post = self._fitted(everything, weight, post, len(patterns), rounds)
        right = (everything == 1) * post[:, None] + (everything == -1) * (1 - post)[:, None]
        self.accuracy = (weight @ right) / np.maximum(weight @ (everything != 0), 1e-9)

    def _codes(self, patterns: np.ndarray) -> list[np.ndarray]:
        return [(patterns[:, clique] + 1) @ 3 ** np.arange(len(clique)) for clique in self.cliques]

    def _fitted(self, patterns: np.ndarray, weight: np.ndarray, post: np.ndarray, free: int, rounds: int) -> np.ndarray:
        """Alternate tables and posteriors; only the first ``free`` rows have a hidden label."""
        codes = self._codes(patterns)
        for _ in range(rounds):
            self.tables = []
            for clique, code in zip(self.cliques, codes, strict=True):
                both = np.array([np.bincount(code, weight * side, 3 ** len(clique)) for side in (post, 1 - post)])
                pooled = both.sum(0) / max(both.sum(), 1e-9)
                self.tables.append(np.log((both + 2 * pooled + 0.01) / (both.sum(1, keepdims=True) + 2 + 0.01 * both.shape[1])))
            post = np.concatenate([self.posterior(patterns[:free]), post[free:]])
        return post

    def _correlations(self, patterns: np.ndarray, weight: np.ndarray, post: np.ndarray) -> np.ndarray:
        residual = np.zeros((patterns.shape[1],) * 2)
        for mass in (weight * post, weight * (1 - post)):
            if mass.sum() > 0:
                off = patterns - mass @ patterns / mass.sum()
                residual += off.T @ (off * mass[:, None])
        spread = np.sqrt(np.maximum(residual.diagonal(), 1e-9))
        return residual / np.outer(spread, spread)

    def _join(self) -> None:
        pairs = [(abs(self.correlation[i, j]), i, j) for i in range(len(self.correlation)) for j in range(i)]
        for strength, i, j in sorted(pairs, reverse=True):
            if strength < CORRELATED:
                break
            a, b = (next(c for c in self.cliques if x in c) for x in (i, j))
            if a is not b and len(a) + len(b) <= CLIQUE:
                self.cliques.remove(b)
                a.extend(b)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of label toxic for each pattern."""
        odds = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for table, code in zip(self.tables, self._codes(patterns), strict=True):
            odds += (table[0] - table[1])[code]
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


class Linear:
    """Logistic regression on the units of the lexicon (presence) and the votes, fitted to soft labels of rows that have weights."""

    def __init__(self, at: list[list[int]], patterns: np.ndarray, soft: np.ndarray, n_units: int, weights: np.ndarray | None = None, reg: float = 1e-3, steps: int = 400):
        self.n_units = n_units
        rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
        units_at = np.array([u for a in at for u in a], np.int64)
        w, v, b, vb = np.zeros(n_units), np.zeros(patterns.shape[1]), 0.0, 0.0
        n = len(at)
        share = (np.ones(n) if weights is None else weights) / max(n if weights is None else weights.sum(), 1e-9)
        scale = 1.0 / max(1.0, float(np.sqrt(max((len(a) for a in at), default=1))))
        last = (w, v, b if n else NOTHING_LEARNT)
        for step in range(steps if n else 0):
            z = np.bincount(rows, w[units_at], n) if len(rows) else np.zeros(n)
            error = share * (1 / (1 + np.exp(-np.clip(z + patterns @ v + b, -30, 30))) - soft)
            g_w = np.bincount(units_at, error[rows], n_units) + reg * w if len(rows) else reg * w
            new = (w - 8 * scale * g_w, v - 1.0 * (patterns.T @ error + reg * v), b - 1.0 * error.sum())
            push = step / (step + 3)
            w, v, b = (x + push * (x - y) for x, y in zip(new, last, strict=True))
            last = new
        self.w, self.v, self.b = last

    def scores(self, masks: np.ndarray, at: list[list[int]]) -> np.ndarray:
        """Probability of toxic for rows of votes and units."""
        z = self.b + voted(masks) @ self.v
        z += np.bincount(np.repeat(np.arange(len(at)), [len(a) for a in at]), self.w[[u for a in at for u in a]], len(at)) if self.n_units else 0
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def voted_rows(rows: DataFrame, lexicon: dict[str, tuple[int, bool]]) -> DataFrame:
    """``tag, mask, at``: the votes and units of every whole text of ``tag, body``."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON_UNITS units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [votes(t.as_py(), shared.value) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([m for m, _ in found], pa.int32()), pa.array([a for _, a in found], pa.list_(pa.int32()))], names=["tag", "mask", "at"])

    return rows.select(F.col("tag").cast("long"), "body").mapInArrow(run, "tag long, mask int, at array<int>")


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> tuple[DataFrame, dict[str, tuple[int, bool]], LabelModel, Linear]:
    """Every document's votes (``tag`` its id, ``mask``, ``at``; staged), the lexicon, label model and classifier.

    Labels come only from documents outside the held-out quarter; those without a
    document, or with a null id or label, teach nothing. Votes are made once and
    serve both the label model and the scores. Repeated documents vote as often as
    they occur. With empty tables the lexicon is empty and scores are the
    intercept's.
    """
    rows, once = labelled_texts(docs, labels)
    counted = once.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.round("weight", 6).cast("decimal(28,6)")).cast("double").alias("weight")).collect()  # a row a label
    sizes, mass = {row["toxic"]: row["n"] for row in counted}, {row["toxic"]: row["weight"] for row in counted}
    lexicon = mine_lexicon(rows.join(few(once.select("at", "toxic", "weight")), "at").select("body", "toxic", "weight"), mass.get(1, 0), sum(n for label, n in mass.items() if label != 1))
    # The tag holds the label and, of its weight, a millionth as unit.
    sample = training_sample(rows, once, sizes, toxic_rows, clean_rows).select((F.round(F.col("weight") * 1_000_000).cast("long") * 2 + (F.col("toxic") == 1).cast("long")).alias("tag"), "body")
    seen = voted_rows(sample, lexicon).collect()  # bounded by the sample
    seen.sort(key=lambda row: (row["tag"], row["mask"], row["at"]))
    weights, toxic = np.array([(row["tag"] >> 1) / 1_000_000 for row in seen]), np.array([float(row["tag"] & 1) for row in seen])
    voted_docs = staged(voted_rows(docs.select(F.col("doc_id").alias("tag"), F.col("text").alias("body")), lexicon), "toxicity-votes")
    rate = labels.where(~held_out(F.col("doc_id"), 4, 2)).agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    grouped = voted_docs.groupBy("mask").agg(F.count("*").alias("n")).collect()  # at most 2^18 rows whatever the input
    own = voted([row["mask"] for row in seen])
    model = LabelModel(voted([row["mask"] for row in grouped]), np.array([row["n"] for row in grouped], float), rate or 0.05, own, toxic, weights)
    return voted_docs, lexicon, model, Linear([row["at"] for row in seen], own, model.posterior(own), len(lexicon), weights)


def score(voted_docs: DataFrame, linear: Linear, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every row of votes; a score at the threshold is toxic. A null or empty text is scored by the intercept and its votes."""
    shared = voted_docs.sparkSession.sparkContext.broadcast(linear)  # at most LEXICON_UNITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(1).to_numpy(), batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return voted_docs.select("tag", "mask", "at").mapInArrow(run, "doc_id long, score double, predicted int")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of query ``op3_toxicity``."""
    voted_docs, _, _, linear = fit(docs, labels)
    return score(voted_docs, linear).withColumn("held_out", held_out(F.col("doc_id"), 4, 2)).select("doc_id", "held_out", "score", "predicted")

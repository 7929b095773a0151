"""Toxicity scores from weak supervision.

Voters are words and word beginnings, from a fixed lexicon and from a bounded sample of labelled
documents (those far commoner in either kind, which finds the insults of any language), and patterns of
speech: threats, commands to go, masked oaths, shouting on the one side, courtesy and reference on the
other. Each says something of a document that has it and abstains of others. A generative label model,
fitted by expectation maximisation, estimates how often each voter (the given label is one of them)
speaks up in either class, and how far voters repeat each other given the class, which divides their
weight; its posterior says how likely each sampled document is toxic, given all votes. A linear
classifier is trained on these posteriors and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch

# Insults that the lexicon voters look for.
LEXICON = (
    "asshole bastard bitch bullshit clown coward cretin degenerate disgusting dumb dumbass fool freak fuck garbage idiot imbecile jerk kill loser lowlife maggot moron nasty parasite "
    "pathetic pig prick repulsive retard scum shit shut slut stupid sucker trash ugly vermin vile whore worthless"
).split()

# Patterns of speech whose voters look at whole texts; the label model finds which side each is on, and how far it can be trusted.
PATTERNS = (
    r"(?i)\b(?:you|ya|u)(?:'?re| are)? (?:an? |such an? |all |so |just )*(?:idiot|moron|loser|clown|pig|fool|jerk|trash|scum|pathetic|stupid|dumb|worthless|disgusting|ugly)",
    r"(?i)\b(?:i|we)(?:'?ll| will| am going to|'?m going to| gonna) (?:kill|hurt|find|destroy|beat|get) (?:you|u|them|him|her)\b",
    r"(?i)\b(?:go (?:to hell|die|away|kill)|get (?:lost|out)|shut (?:up|it)|drop dead|screw you|damn you)\b",
    r"(?i)\b(?:hate|despise|loathe) (?:you|u|them|those|these|people|all)\b",
    r"(?i)\b(?:nobody|no one|everyone|everybody) (?:likes|wants|cares about|hates) (?:you|u|them)\b",
    r"(?i)\b[a-z]{1,2}[*@#$%!]{2,}[a-z]{0,3}\b",
    r"(?:\b[A-Z]{3,}\b[ ,!]+){3,}",
    r"[!?]{3,}",
    r"(?i)\b(?:please|thank you|thanks|kind regards|sincerely|welcome|sorry|excuse me|would you mind)\b",
    r"(?i)\b(?:for example|in other words|according to|as well as|in addition|see also|in general|is defined as)\b",
    r"(?i)https?://|\bdoi:|\[[0-9]{1,3}\]",
    r"(?m)^[ \t]*(?:[-*]|[0-9]+[.)])[ \t]+\S",
)

#: Bytes of the word beginnings that may become voters; longer words count whole as well.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Labelled documents that the fit uses, the first by a hash of doc_id.
MOST_TOXIC, MOST_CLEAN = 2000, 4000
#: Word voters that the sample adds for either class: those that tell most, of those in a hundredth of its documents and in four of them at least. Part of the fit, like the sample.
MOST_VOTERS = 300
#: Standard errors by which a voter's rates in the two classes must differ.
SIGMAS = 4


def features(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, feature hash, word index, words of each row before it) over a string column."""
    text = pc.utf8_lower(text.cast(pa.large_string()))
    for i, j, data, bounds in K.chunks(text):
        words = K.Words(data, bounds, alphabet=K.ALNUM)
        size = words.end - words.start
        hashes, at = [words.hash], [np.arange(len(size))]
        for n in PREFIXES:
            long = np.flatnonzero(size > n)
            hashes.append(_prefix_hash(data, words.start[long], n))
            at.append(long)
        yield i, j, np.concatenate(hashes), np.concatenate(at), words.first


def _prefix_hash(data: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(start), dtype=np.uint64)
    for b in range(n):
        out |= data[start + b].astype(np.uint64) << np.uint64(8 * b)
    return K.mix(out + np.uint64(K._odd(500 + n)))


def lexicon_hashes() -> np.ndarray:
    """One word a row, so that the first hashes are those of the whole words."""
    return np.concatenate([h[: j - i] for i, j, h, _, _ in features(pa.array(LEXICON))])


def _miner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean): in how many of this task's documents of either label each feature is."""
    found: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for batch in batches:
        label = batch.column(1).to_numpy()
        for i, j, h, at, first in features(batch.column(0)):
            doc = np.searchsorted(first, at, side="right") - 1
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            once = np.ones(len(h), dtype=bool)
            once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            for y in (0, 1):
                found[y].append(h[once & (label[i:j][doc] == y)] if len(h) else h)
    seen = {y: np.unique(np.concatenate(v), return_counts=True) for y, v in found.items() if v}
    for y, (h, n) in seen.items():
        zero = np.zeros(len(h), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n if y else zero), pa.array(zero if y else n)], names=["feature", "toxic", "clean"])


class Lookup:
    """Index of each feature hash among the voters."""

    def __init__(self, voters: np.ndarray):
        self.order = np.argsort(voters)
        self.sorted = voters[self.order]
        self.screen = np.zeros(1 << 16, dtype=bool)
        self.screen[(voters & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of voters, and which."""
        at = np.flatnonzero(self.screen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        hit = self.sorted[place] == h[at]
        return at[hit], self.order[place[hit]]


class Voters:
    """Words and word beginnings by hash, then patterns, numbered in this order."""

    def __init__(self, words: np.ndarray, patterns: Sequence[str]):
        self.words, self.patterns, self.lookup = words, tuple(patterns), Lookup(words)

    def __len__(self) -> int:
        return len(self.words) + len(self.patterns)

    def chosen(self, which: np.ndarray) -> Voters:
        n = len(self.words)
        return Voters(self.words[which[which < n]], [self.patterns[i - n] for i in which[which >= n]])

    def votes(self, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, row of each vote, its voter, words with a vote by row, words by row), votes once for each row and voter."""
        n, text = len(self), text.cast(pa.large_string())
        spoke = [pc.fill_null(pc.match_substring_regex(text, p), False).to_numpy(zero_copy_only=False) for p in self.patterns]
        for i, j, h, at, first in features(text):
            place, voter = self.lookup(h)
            word = at[place]
            row = np.searchsorted(first, word, side="right") - 1
            rows = np.searchsorted(first, np.unique(word), side="right") - 1
            marks = [np.unique(row * n + voter)]
            marks += [np.flatnonzero(s[i:j]) * n + len(self.words) + k for k, s in enumerate(spoke)]
            once = np.sort(np.concatenate(marks))
            yield i, j, once // n, once % n, np.bincount(rows, minlength=j - i), np.diff(first)


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 10, correlated: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each document; the rate at which each voter speaks up in either class (2 x voters, the given label last); the weight of each voter.

    Whether a voter speaks up is a draw with its rate in the document's class, so silence tells
    something too, of rare voters little. The given label always speaks, and is trusted as far as the
    others bear it out. What two voters have in common beyond the class divides their weight, unless
    they count as independent.
    """
    votes = votes.astype(np.float64)
    post = np.where(label > 0, 0.8, 0.2)
    rates, weight, own = np.zeros((2, votes.shape[1])), np.ones(votes.shape[1]), np.zeros(2)
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        for y, p in ((0, 1 - post), (1, post)):
            rates[y] = (p @ votes + 0.5) / (p.sum() + 1)
            own[y] = np.clip((p @ label + 0.5) / (p.sum() + 1), 0.005, 0.995)
        if correlated:
            rest = votes - np.outer(post, rates[1]) - np.outer(1 - post, rates[0])
            rest /= np.maximum(rest.std(axis=0), 1e-6)
            corr = np.abs(rest.T @ rest / max(len(rest), 1))
            weight = 1 / np.where(corr > 0.1, corr, 0).sum(axis=1).clip(1)
        logit = np.log(prior / (1 - prior)) + np.where(label > 0, np.log(own[1] / own[0]), np.log((1 - own[1]) / (1 - own[0])))
        logit += votes @ (weight * np.log(rates[1] / rates[0])) + (1 - votes) @ (weight * np.log((1 - rates[1]) / (1 - rates[0])))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, np.column_stack([rates, own]), weight


def accuracies(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """How far each voter can be trusted: of the posterior weight of the documents on which it speaks, the share on its own side."""
    toxic = (post @ votes) / np.maximum(votes.sum(axis=0), 1)
    return np.maximum(toxic, 1 - toxic)


def independent(votes: np.ndarray, most: float = 0.6) -> np.ndarray:
    """Indices of voters, in order, of which none speaks up in nearly the same documents as an earlier one."""
    v = votes.astype(np.float64)
    both, size = v.T @ v, v.sum(axis=0)
    kept: list[int] = []
    for f in range(v.shape[1]):
        if size[f] and all(both[f, g] <= most * (size[f] + size[g] - both[f, g]) for g in kept):
            kept.append(f)
    return np.array(kept, dtype=np.int64)


def dense(rows: np.ndarray, voter: np.ndarray, hits: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """The classifier's inputs: who votes, how many words have a vote, and their share."""
    x = np.zeros((len(hits), n + 2))
    x[rows, voter] = 1
    x[:, n] = np.log1p(hits)
    x[:, n + 1] = np.minimum(100 * hits / np.maximum(words, 20), 5)
    return x


def linear_fit(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on soft labels (Newton's method)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - target @ z + 0.5 * penalty @ (w * w))

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (target - p) - penalty * w)
        while (after := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w, gain, now = w + step, now - after, after
        if gain < 1e-6:
            break
    return w


def _inputs(sample: DataFrame, voters: Voters) -> tuple[np.ndarray, np.ndarray]:
    """The classifier's inputs and the label of each row of a bounded sample."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, 0):
            for i, j, row, voter, hits, words in voters.votes(batch.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i), K.lists(voter, np.bincount(row, minlength=j - i), pa.int32()), pa.array(hits), pa.array(words)],
                    names=["toxic", "voters", "hits", "words"],
                )

    got = sample.select("text", "toxic").mapInArrow(vote, "toxic int, voters array<int>, hits long, words long").toArrow()
    lists = got.column("voters").combine_chunks()
    rows = np.repeat(np.arange(len(got)), np.diff(lists.offsets.to_numpy()))
    return dense(rows, lists.flatten().to_numpy(), got.column("hits").to_numpy(), got.column("words").to_numpy(), len(voters)), got.column("toxic").to_numpy()


def fit(sample: DataFrame) -> tuple[Voters, np.ndarray]:
    """Voters and classifier weights from a bounded sample (text, toxic)."""
    lexicon = lexicon_hashes()
    totals = {int(r.toxic): r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:  # nothing to learn from: the lexicon alone, a word in fifty being enough
        weights = np.zeros(len(lexicon) + 3)
        weights[-2:] = 3.0, -3.0
        return Voters(lexicon, ()), weights
    counts = sample.select("text", "toxic").mapInArrow(_miner, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    mined = [lexicon]
    for side, other, n, m in (("t", "c", toxic, clean), ("c", "t", clean, toxic)):
        p, q = (F.col(side) + 0.5) / (n + 1), (F.col(other) + 0.5) / (m + 1)
        gain = F.col(side) * F.log(p / q) + (n - F.col(side) + 0.5) * F.log((1 - p + 1e-9) / (1 - q + 1e-9))
        pooled = (F.col("t") + F.col("c") + 1) / (n + m + 2)
        apart = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
        best = counts.filter((F.col(side) >= max(4, 0.01 * n)) & (p > 4 * q) & (apart >= SIGMAS)).orderBy(gain.desc(), "feature").limit(MOST_VOTERS).select("feature").collect()
        found = np.array([r.feature for r in best], dtype=np.int64).view(np.uint64)
        mined.append(found[~np.isin(found, lexicon)])
    voters = Voters(np.concatenate(mined), PATTERNS)
    x, _ = _inputs(sample, voters)
    voters = voters.chosen(independent(x[:, :-2]))
    x, label = _inputs(sample, voters)  # words and shares again, of the voters that stay
    post, _, _ = label_model(x[:, :-2], label)
    return voters, linear_fit(x, post)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (1 from 0.7), and, as a struct, kept: the columns of ``keep``.

    Learns from rows of ``labels`` (doc_id, toxic) whose crc32(doc_id as text) mod 3 is not 1, from
    the first ``MOST_TOXIC`` and ``MOST_CLEAN`` of them by a hash of doc_id; of several labels of a
    doc_id the highest counts, of several texts the first in their order. Only the text enters a score. Without labelled rows of both kinds the
    lexicon alone decides.

    A null or empty text gets the score of a text without votes. A row without doc_id is held out
    (held_out is false only for rows that may teach). Rows that repeat get equal rows. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(known.filter("toxic = 0").orderBy(*order).limit(MOST_CLEAN))
    # Ids meet as text, whatever type either table gives them; of several rows of an id one teaches, so that the sample stays bounded.
    chosen = scratch.table("chosen", chosen.select(F.col("doc_id").cast("string").alias("id"), "toxic"))
    met = texts.select(F.col("doc_id").cast("string").alias("id"), "text").join(F.broadcast(chosen), "id")
    sample = scratch.table("sample", met.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    voters, weights = fit(sample)
    scratch.drop("sample", "chosen")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(voters)
        for batch in K.pieces(batches, 2):
            for i, j, row, voter, hits, words in voters.votes(batch.column(2)):
                logit = np.bincount(row, weights=weights[voter], minlength=j - i).astype(np.float64)  # of no votes it makes integers
                logit += weights[n] * np.log1p(hits) + weights[n + 1] * np.minimum(100 * hits / np.maximum(words, 20), 5) + weights[n + 2]
                own = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([own[0], own[1], pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30)))), *own[3:]], names=["doc_id", "held_out", "score", "kept"][: 3 + len(own[3:])])

    # A struct keeps names that clash with this operator's own apart.
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept)
    rows = rows.select("doc_id", held.alias("held_out"), "text", *(["kept"] if keep else []))
    kinds = dict(rows.dtypes)
    schema = f"doc_id {kinds['doc_id']}, held_out boolean, score double" + (f", kept {kinds['kept']}" if keep else "")
    out = rows.mapInArrow(score, schema)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), *(["kept"] if keep else []))

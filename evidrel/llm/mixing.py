"""Mixing sources to target weights with soft domain membership.

A labelled table says for some documents which domain they belong to. A naive
Bayes classifier over the presence of hashed words and sign runs, counted from a
bounded sample of them and calibrated on a part of it that is kept out of the
counts, gives every document a posterior over the domains. Only words count
whose documents lie in the domains otherwise than chance would have it, so a few
telling words are not lost among the many of a long text. Document rates r >= least >= 0 are then fitted so
that the expected tokens of each domain, the sum of r * tokens * posterior, meet
the target totals: least squares by projected gradient steps from r = 1, with
the projection applied lazily (r = max(least, 1 - posterior . u), u being the
sum of all steps) and the steps scaled by the inverse Gram matrix of the
posteriors whose rates are free. A step needs one aggregate of a few numbers.

Everything is DataFrame code. What the driver holds is the table of telling words
and one vector by domain.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.llm.common import hashed_sample, written

#: Words and sign runs that tell domains apart, the most telling ones, at most.
WORDS = 4096
#: Steps at most, and the relative miss of the targets that ends the fit.
STEPS, CLOSE = 40, 1e-3
#: Labelled documents of each domain that the word weights are counted from at most.
FIT_DOCS = 8000
#: Part of the most probable domain's posterior from which a document counts as one that may belong to the kept domain.
MAY_BELONG = 0.2
#: Documents that a domain's share of a word is drawn towards all domains' share by.
SMOOTH = 5.0
#: Letters and digits, or other signs, that stand together.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the distinct words and sign runs of a text (null: none), lower-cased."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(w)))


def word_count(text: Column) -> Column:
    """Words of a text (null: none), separated by spaces and line ends."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\n]"), lambda w: w != ""))


def constant_array(values: list, kind: str = "double") -> Column:
    """An array that is folded to a constant once."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


#: How many deviations above chance a word's documents must be in a domain, and what the evidence may be divided by; calibration takes the best.
CUTS, FACTORS = (3.0, 4.0, 6.0, 9.0), tuple(2.0**k for k in range(-1, 6))
#: How many times as likely as in the others a word must be in such a domain (log).
LEAST_RATIO = 1.0


def presence(counts: np.ndarray, docs: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """What a present word adds to each domain's log probability, (domains, words), and what no word at all gives.

    counts[d, w] of docs[d] documents of domain d hold word w. Words add nothing
    that are not, in one domain at least, ``cut`` deviations above their part of
    all documents and so much likelier than in the others.
    """
    part = counts.sum(axis=0) / max(docs.sum(), 1)
    p = np.clip((counts + SMOOTH * part) / (docs[:, None] + SMOOTH), 1e-6, 1 - 1e-6)
    above = (counts - docs[:, None] * part) / np.sqrt(docs[:, None] * part + 1) >= cut
    rest = (counts.sum(axis=0) - counts + SMOOTH * part) / (docs.sum() - docs[:, None] + SMOOTH)
    telling = (above & (np.log(p / np.maximum(rest, 1e-9)) >= LEAST_RATIO)).any(axis=0)
    on, off = np.where(telling, np.log(p) - np.log1p(-p), 0.0), np.where(telling, np.log1p(-p), 0.0).sum(axis=1)
    return on - on.mean(axis=0), off - off.mean()


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, sample: int = FIT_DOCS) -> tuple[list[int], list[list[float]], list[float]]:
    """Hashes of telling words, what each adds to the domains' log probabilities, and what these begin with.

    Documents are counted from at most ``sample`` labelled ones of each domain;
    every fourth of them is kept out and says how far from chance a word must be
    and how far the evidence of a text can be trusted (words are not independent):
    the least log loss over CUTS and FACTORS.
    """
    known = labelled.select(F.col(id_col), F.col("domain")).where(F.col("domain").isin(domains))
    chosen = hashed_sample(known, id_col, F.col("domain"), sample).select(id_col, "domain", (F.pmod(F.xxhash64(F.col(id_col), F.lit("aside")), F.lit(4)) == 0).alias("aside"))
    # sample narrow rows of each domain at most: texts are not shuffled
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select("domain", "aside", word_hashes(F.col(text_col)).alias("words"))
    sizes = {r["domain"]: r["count"] for r in rows.where(~F.col("aside")).groupBy("domain").count().collect()}
    held_in = np.array([sizes.get(d, 0) for d in domains], float)
    prior = np.array(prior_logs(known, domains))
    part = lambda k: (sum(F.col(f"n{j}") for j in range(len(domains))) / float(max(held_in.sum(), 1))) * float(held_in[k])
    above = F.greatest(*[(F.col(f"n{k}") - part(k)) / F.sqrt(part(k) + 1) for k in range(len(domains))], F.lit(0.0))
    seen = rows.where(~F.col("aside")).select("domain", F.explode("words").alias("w")).groupBy("w").agg(*[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)])
    seen = seen.withColumn("above", above).where(F.col("above") >= min(CUTS)).orderBy(F.desc("above"), "w").limit(WORDS).collect()
    words, counts = [r["w"] for r in seen], np.array([[r[f"n{k}"] for r in seen] for k in range(len(domains))], float)
    if not words:
        return [], [[] for _ in domains], prior.tolist()
    fits = [presence(counts, held_in, cut) for cut in CUTS]
    # sums of the held-out texts for every cut, by a join with the table of weights (WORDS rows)
    names = [f"s{i}_{k}" for i in range(len(CUTS)) for k in range(len(domains))]
    weights = np.vstack([on for on, _ in fits])
    table = docs.sparkSession.createDataFrame([(w, *weights[:, j].tolist()) for j, w in enumerate(words)], f"w bigint, {', '.join(f'{c} double' for c in names)}")
    aside = rows.where("aside").withColumn("row", F.monotonically_increasing_id())  # numbered before its words are rows
    found = aside.select("row", "domain", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), F.col("words"))).alias("w")).join(F.broadcast(table), "w", "left")
    held = found.groupBy("row", "domain").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names]).limit(sample * len(domains)).collect()
    total = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    loss, best = math.inf, (0, 1.0)
    for i, (_, off) in enumerate(fits if held else []):
        sums = [(r["domain"], [r[f"s{i}_{k}"] + off[k] for k in range(len(domains))]) for r in held]
        for factor in FACTORS:
            got = log_loss(sums, domains, prior, factor, total)
            if got < loss:
                loss, best = got, (i, factor)
    on, off = fits[best[0]]
    some = np.flatnonzero(on.any(axis=0))
    return [words[j] for j in some], np.round(on[:, some] / best[1], 6).tolist(), (prior + off / best[1]).tolist()


def prior_logs(labelled: DataFrame, domains: list[str]) -> list[float]:
    """Log parts of the domains among the labels; one is added to each."""
    total = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect() if r["domain"] in domains}
    return [math.log((total.get(d, 0) + 1) / (sum(total.values()) + len(domains))) for d in domains]


def log_loss(held: list[tuple[str, list[float]]], domains: list[str], prior: np.ndarray, factor: float, total: dict[str, int]) -> float:
    """Log loss of labelled rows (domain, sums); each domain counts as often as among all labels, so that posteriors are those of the corpus."""
    y = np.array([domains.index(d) for d, _ in held])
    weight = (np.array([total.get(d, 0) for d in domains]) / np.bincount(y, minlength=len(domains)).clip(1))[y]
    z = prior + np.array([x for _, x in held], float) / factor
    return float((weight * (np.logaddexp.reduce(z, axis=1) - z[np.arange(len(y)), y])).sum())


def weight_sums(words: Column, telling: list[int], logs: list[list[float]]) -> Column:
    """Struct d0, d1, ...: what a text's telling words add to each domain."""
    hashes = constant_array(telling, "bigint")
    start = F.struct(*[F.lit(0.0).alias(f"d{k}") for k in range(len(logs))])
    tables = [F.map_from_arrays(hashes, constant_array(v)) for v in logs]
    add = lambda s, w: F.struct(*[(s[f"d{k}"] + F.element_at(t, w)).alias(f"d{k}") for k, t in enumerate(tables)])
    return F.aggregate(F.array_intersect(words, hashes), start, add) if telling else start


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, p): words of each document and its posterior, in the order of domains.

    A text without words has the prior; without labelled rows the posterior is
    uniform.
    """
    telling, logs, start = classifier(docs, labelled, domains, id_col, text_col)
    rows = docs.select(F.col(id_col), word_count(F.col(text_col)).cast("long").alias("tokens"), weight_sums(word_hashes(F.col(text_col)), telling, logs).alias("s"))
    rows = rows.withColumn("z", F.when(F.col("tokens") > 0, F.array(*[F.lit(float(start[k])) + F.col(f"s.d{k}") for k in range(len(domains))])).otherwise(F.array(*[F.lit(float(x)) for x in prior_logs(labelled, domains)])))
    rows = rows.withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    return rows.select(id_col, "tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def rate(p: Column, u: list[float], least: Column) -> Column:
    """max(least, 1 - p . u)"""
    return F.greatest(least, F.lit(1.0) - sum(F.element_at(p, k + 1) * F.lit(x) for k, x in enumerate(u)))


def fit_rates(members: DataFrame, weights: list[float], anchor: int | None = None) -> tuple[list[float], list[float], list[float]]:
    """u of the fitted rates, and the reached and the wanted part of all tokens for each domain.

    members has (tokens, p, least). The targets are ``weights``, which must sum
    to 1, times all tokens; with an anchor, times so many that the target of that
    domain is what it has at rate 1. A domain without any membership cannot be
    reached, nor can targets below what least rates hold; the rest then is met
    as well as least squares allows.
    """
    n = len(weights)
    part = lambda k: F.element_at("p", k + 1)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    now = members.agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * part(i)).alias(f"m{i}") for i in range(n)]).first()
    total = float(now["n"] or 0)
    if not total:
        return [0.0] * n, [0.0] * n, [0.0] * n
    wanted = np.array(weights)
    if anchor is not None and weights[anchor] > 0:
        wanted = wanted * (now[f"m{anchor}"] / total / weights[anchor])
    u, size, best = np.zeros(n), 1.0, (math.inf, np.zeros(n), np.zeros(n), np.eye(n))
    for _ in range(STEPS):
        r = rate(F.col("p"), u.tolist(), F.col("least"))
        free = F.when(rate(F.col("p"), u.tolist(), F.lit(-1e300)) >= F.col("least"), F.col("tokens")).otherwise(0)
        got = members.agg(*[F.sum(F.col("tokens") * r * part(k)).alias(f"a{k}") for k in range(n)], *[F.sum(free * part(i) * part(j)).alias(f"g{i}_{j}") for i, j in pairs]).first()
        reached = np.array([got[f"a{k}"] for k in range(n)]) / total
        error = float(np.abs(reached - wanted).max())
        if error < best[0]:
            gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) / total
            best, size = (error, u, reached, np.linalg.pinv(gram, rcond=1e-6)), min(1.0, 2 * size)
        else:  # the step was too long: other rates came to their least
            size /= 4
        if error < CLOSE or size < 1e-4:
            break
        u = best[1] + size * best[3] @ (best[2] - wanted)
    return best[1].tolist(), best[2].tolist(), wanted.tolist()


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """(id, tokens, p, rate, copies) for every row of docs.

    weights maps each domain (at most 32) to its part of all tokens. ``keep``
    names a domain none of whose documents may go: what may well belong to it (its
    posterior is MAY_BELONG of the largest) has a rate of at least 1 (the set that
    rates are projected on), and the targets are scaled so that the domain keeps
    its tokens. ``copies`` realises
    the rate: its whole part, and one more where a hash of the id lies below the
    rest, so its expectation is the rate. Null and empty texts have no tokens,
    the prior as posterior and the rate that follows from it; rows that repeat
    an id get equal decisions if their texts are equal; equal posteriors (ties)
    get equal rates; an empty table gives an empty table.
    """
    domains = sorted(weights)
    total = sum(weights.values())
    anchor = domains.index(keep) if keep else None
    least = F.lit(0.0) if anchor is None else F.when(F.element_at("p", anchor + 1) >= F.array_max("p") * MAY_BELONG, 1.0).otherwise(0.0)
    members = written(posteriors(docs, labelled, domains, id_col, text_col).withColumn("least", least), "members")
    u, *_ = fit_rates(members, [weights[d] / total for d in domains], anchor)
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = members.withColumn("rate", rate(F.col("p"), u, F.col("least"))).drop("least")
    return out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))

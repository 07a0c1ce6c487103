"""Soft-membership mixing to target weights, in DataFrame and SQL functions only.

1. A classifier fitted on the label table (a bounded sample of labelled documents) gives every document a
   posterior over the domains poor, toxic and good. Log likelihood ratios of hashed words, fitted on most of
   the sample, give a document's evidence for each domain: their sum over the root of the length, and the
   strongest word. A softmax regression on the rest of the sample, which the ratios never saw, calibrates
   this evidence. Posteriors are part of the model in steps of 1 / STEPS, so documents share a bounded
   number of distinct ones.
2. Nonnegative rates minimise the squared distance between expected domain token totals and their
   targets. With tokens as weights a document's gradient step depends on its posterior alone, so
   projected gradient runs over the table of distinct posteriors (at most (STEPS + 1) * (STEPS + 2) / 2
   rows, whatever the corpus), which is one row of arrays; a job takes CHUNK steps, and then only the
   totals reach the driver.
3. Each document gets its posterior's rate; copies = floor(rate + u) with u from a hash of the id.

Edge cases: null and empty texts have no tokens and get the domains' shares in the sample as posterior; null labels are left
out; without labels every document is good; a domain without mass cannot reach its target, the others
still do; repeated rows are separate documents with the same rate; an empty table gives an empty
result. Other columns are ignored; mix() keeps them, whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared

DOMAINS = ("poor", "toxic", "good")
TARGETS = {"poor": 0.05, "toxic": 0.01, "good": 0.94}
BUCKETS, STEPS, ROUNDS, CHUNK, MAX_ROWS, MAX_RATE, SHRINK = 1 << 16, 64, 20_000, 250, 10_000, 4.0, 20.0
SPLIT = "[ \\t-\\r]+"


def words(text: Column | str = "text") -> Column:
    """Lower-case words; one empty word for a text without any."""
    text = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), SPLIT)


def domain() -> Column:
    """0 poor, 1 toxic, 2 good, from the label columns."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def evidence(rows: DataFrame, weights: DataFrame, *keep: str) -> DataFrame:
    """keep, n (words), m (how many equal rows), and for poor and toxic s0, s1 (sum over root of n), t0, t1 (strongest, 0 at least).

    rows hold text beside the columns to keep. Words meet the weights by a broadcast of BUCKETS rows and
    are summed before anything is shuffled, so a document costs one narrow row. Equal rows share a group
    and are counted apart afterwards.
    """
    rows = rows.select(*keep, words().alias("words"))
    rows = rows.select(*keep, F.when(F.element_at("words", 1) == "", 0).otherwise(F.size("words")).alias("n"), F.explode("words").alias("word"))
    rows = rows.select(*keep, "n", bucket(F.col("word")).alias("w_bucket")).join(F.broadcast(weights), "w_bucket", "left")
    rows = rows.select(*keep, "n", *[F.when(F.col("n") > 0, F.coalesce(f"r{k}", F.lit(0.0))).otherwise(0.0).alias(f"r{k}") for k in (0, 1)])
    sums = rows.groupBy(*keep, "n").agg(F.count(F.lit(1)).alias("words"), *[f(f"r{k}").alias(f"{name}{k}") for k in (0, 1) for name, f in (("s", F.sum), ("t", F.max))])
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    m = F.round(F.col("words") / n).cast("int")
    return sums.select(*keep, F.col("n").cast("bigint").alias("n"), m.alias("m"), *[(F.col(f"s{k}") / m / F.sqrt(n)).alias(f"s{k}") for k in (0, 1)], *[F.greatest(F.col(f"t{k}"), F.lit(0.0)).alias(f"t{k}") for k in (0, 1)])


def calibrate(x: np.ndarray, y: np.ndarray, start: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Coefficients (2, features) of the log odds of poor and toxic against good: Newton's method, drawn to start."""
    w = start.copy()
    hits = np.stack([y == 0, y == 1]).astype(float)
    for _ in range(50):
        z = np.clip(w @ x.T, -30, 30)
        p = np.exp(z) / (1 + np.exp(z).sum(0))
        slope = (p - hits) @ x + penalty * (w - start)
        d = x.shape[1]
        bend = penalty * np.eye(2 * d)
        for i in range(2):
            for j in range(2):
                bend[i * d : (i + 1) * d, j * d : (j + 1) * d] += (x.T * (p[i] * ((i == j) - p[j]))) @ x
        move = np.linalg.solve(bend, slope.ravel()).reshape(2, d)
        w -= move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Log likelihood ratios against `good` by bucket; the calibration's coefficients; the domains' log odds in the sample."""
    picked = _shared.labelled_sample(docs.select("doc_id", "text"), labels.withColumn("domain", domain()).select("doc_id", "domain"), ["domain"], max_rows)
    picked = _shared.stored(picked.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0), "mix-sample")
    sizes = {k: {r["label_domain"]: r["count"] for r in picked.filter(x).groupBy("label_domain").count().collect()} for k, x in (("all", F.lit(True)), ("fit", ~F.col("held")))}
    total = sum(sizes["all"].values())
    prior = [float(np.log((sizes["all"].get(k, 0) + 0.5) / (sizes["all"].get(2, 0) + 0.5))) if total else -20.0 for k in range(2)]
    # presence of a word's bucket in a document, not its count, so that one long document decides little
    seen = picked.filter("not held").select("label_domain", F.explode(F.array_distinct(F.transform(words(), bucket))).alias("bucket"))
    counts = seen.groupBy("bucket").agg(*[F.count(F.when(F.col("label_domain") == k, 1)).alias(f"c{k}") for k in range(3)])
    # each word's own share of a domain, drawn to the sample's by SHRINK documents
    base = [max(sizes["fit"].get(k, 0), 1) / max(sum(sizes["fit"].values()), 1) for k in range(3)]
    n = F.col("c0") + F.col("c1") + F.col("c2")
    share = [(F.col(f"c{k}") + SHRINK * base[k]) / (n + SHRINK) for k in range(3)]
    ratios = [(F.log(share[k] / share[2]) - float(np.log(base[k] / base[2]))).alias(f"r{k}") for k in (0, 1)]
    # at most BUCKETS rows
    weights = _shared.stored(counts.select(F.col("bucket").alias("w_bucket"), *ratios), "mix-weights")
    # a quarter of at most max_rows narrow rows
    held = evidence(picked.filter("held").select("doc_id", "label_domain", "text"), weights, "doc_id", "label_domain").collect()
    start = np.array([[prior[0], 1.0, 0.0, 0.0, 0.0], [prior[1], 0.0, 1.0, 0.0, 0.0]])
    if held and total:
        x = np.array([[1.0, r["s0"], r["s1"], r["t0"], r["t1"]] for r in sorted(held, key=lambda r: r["doc_id"])])
        start = calibrate(x, np.array([r["label_domain"] for r in sorted(held, key=lambda r: r["doc_id"])]), start)
    _shared.forget(picked)
    return weights, start, prior


def posteriors(docs: DataFrame, model: tuple[DataFrame, np.ndarray, list[float]]) -> DataFrame:
    """doc_id, mix_hash (of the text), n_tokens and p_poor, p_toxic, p_good in steps of 1 / STEPS; a row for each of docs."""
    weights, coefficients, prior = model
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mix_hash"), "text")
    sums = evidence(rows, weights, "doc_id", "mix_hash")
    x = [F.lit(1.0), F.col("s0"), F.col("s1"), F.col("t0"), F.col("t1")]
    z = [F.when(F.col("n") == 0, F.lit(prior[k])).otherwise(sum((float(c) * v for c, v in zip(coefficients[k], x)), F.lit(0.0))) for k in (0, 1)]
    e = [F.exp(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), v))) for v in z]
    sums = sums.select("doc_id", "mix_hash", "m", F.col("n").alias("n_tokens"), e[0].alias("a"), e[1].alias("b"))
    whole = 1.0 + F.col("a") + F.col("b")
    sums = sums.withColumn("p_poor", F.floor(F.col("a") / whole * STEPS + 0.5) / STEPS)
    sums = sums.withColumn("p_toxic", F.least(F.floor(F.col("b") / whole * STEPS + 0.5) / STEPS, 1.0 - F.col("p_poor")))
    sums = sums.withColumn("p_good", 1.0 - F.col("p_poor") - F.col("p_toxic"))
    return sums.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("m")))).drop("m", "a", "b")


def bound(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def steps(chunk: int, goal: np.ndarray, scale: np.ndarray, eta: float, max_rate: float) -> Column:
    """The state (at: rate and extrapolated rate of each of cells; momentum; last) after that many accelerated projected gradient steps."""
    axes = range(len(goal))

    def step(state: Column, _: Column) -> Column:
        rows = F.zip_with("cells", state["at"], lambda c, x: F.struct(*[c[f"p{k}"].alias(f"p{k}") for k in axes], c["tokens"].alias("tokens"), x["r"].alias("r"), x["a"].alias("a")))
        none = F.struct(*[F.lit(0.0).alias(f"{x}{k}") for x in "ra" for k in axes])
        totals = F.aggregate(rows, none, lambda t, x: F.struct(*[(t[f"{v}{k}"] + x["tokens"] * x[v] * x[f"p{k}"]).alias(f"{v}{k}") for v in "ra" for k in axes]))

        def told(t: Column) -> Column:
            value = sum(((t[f"r{k}"] - float(goal[k])) * (t[f"r{k}"] - float(goal[k])) / float(scale[k]) for k in axes), F.lit(0.0))
            momentum = F.when(value > state["last"], 1.0).otherwise(state["momentum"])  # a worse step starts the acceleration anew
            return F.struct(value.alias("value"), momentum.alias("m"), ((1 + F.sqrt(1 + 4 * momentum * momentum)) / 2).alias("further"), *[(float(eta / scale[k]) * (float(goal[k]) - t[f"a{k}"])).alias(f"d{k}") for k in axes])

        def moved(s: Column) -> Column:
            def cell(x: Column) -> Column:
                new = F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), x["a"] + sum((x[f"p{k}"] * s[f"d{k}"] for k in axes), F.lit(0.0))))
                return bound(new, lambda n: F.struct(n.alias("r"), (n + (s["m"] - 1) / s["further"] * (n - x["r"])).alias("a")))

            return F.struct(F.transform(rows, cell).alias("at"), s["further"].alias("momentum"), s["value"].alias("last"))

        return bound(bound(totals, told), moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(chunk)), F.col("state"), step)


def rates(cells: DataFrame, targets: dict[str, float], max_rate: float, rounds: int = ROUNDS) -> tuple[DataFrame, list[dict]]:
    """cells (p_*, tokens) with the fitted rate, and the totals after each chunk of rounds.

    Accelerated projected gradient: a step from the extrapolated rates, cut to 0 .. max_rate. It ends where
    the targets are met, or where the duality gap shows that no rates come nearer; rounds is a guard, with
    a warning where it ends the steps.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    tokens = F.col("tokens")
    grams = cells.agg(F.sum("tokens").alias("n"), *[F.sum(tokens * p[i] * p[j]).alias(f"g{i}{j}") for i in range(3) for j in range(3)]).first()
    start = min(1.0, float(max_rate))
    if not grams["n"]:
        return cells.withColumn("rate", F.lit(start)), []
    gram = np.array([[grams[f"g{i}{j}"] for j in range(3)] for i in range(3)], float)
    mass = gram.sum(1)
    goal = np.array([max(targets.get(d, 0.0), 1e-9) for d in DOMAINS])
    goal = goal / goal.sum()
    # rates that can only fall leave `good` as it is and the others follow; else the total stays
    goal = goal * (min(grams["n"], mass[2] / goal[2]) if max_rate <= 1 else grams["n"])
    scale = np.maximum(goal, mass)  # equations are scaled, so that rare and common domains move alike
    eta = 1.0 / max(np.linalg.eigvalsh(gram / np.sqrt(np.outer(scale, scale))).max(), 1e-12)
    near = 1e-4 * goal.sum()
    # a bounded number of distinct posteriors: one row of arrays
    fields = [F.col(f"p_{d}").cast("double").alias(f"p{k}") for k, d in enumerate(DOMAINS)]
    state = cells.agg(F.sort_array(F.collect_list(F.struct(*fields, tokens.cast("double").alias("tokens")))).alias("cells"))
    first = F.transform("cells", lambda c: F.struct(F.lit(start).alias("r"), F.lit(start).alias("a")))
    state = _shared.stored(state.withColumn("state", F.struct(first.alias("at"), F.lit(1.0).alias("momentum"), F.lit(1e300).alias("last"))), "mix-state")
    told, done = [], 0
    while True:
        flat = state.select(F.explode(F.zip_with("cells", "state.at", lambda c, x: F.struct(*[c[f"p{k}"].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], c["tokens"].alias("tokens"), x["r"].alias("rate")))).alias("x")).select("x.*")
        now = flat.agg(*[F.sum(tokens * F.col("rate") * x).alias(d) for d, x in zip(DOMAINS, p)]).first()
        told.append({d: float(now[d]) for d in DOMAINS} | {"goal": goal.tolist(), "rounds": done})
        if max(abs(now[d] - g) for d, g in zip(DOMAINS, goal)) < near:
            break
        slope = sum((x * float((now[d] - g) / c) for x, d, g, c in zip(p, DOMAINS, goal, scale)), F.lit(0.0))
        gap = flat.agg(F.sum(tokens * slope * (F.col("rate") - F.when(slope > 0, 0.0).otherwise(float(max_rate))))).first()[0]
        if gap <= near**2 / (2 * scale.max()):  # then every total is within `near` of the best one
            break
        if done >= rounds:
            warnings.warn(f"mixing rates are not settled after {done} rounds", stacklevel=2)
            break
        before, chunk = state, min(CHUNK, rounds - done)
        state = _shared.stored(state.select("cells", steps(chunk, goal, scale, eta, max_rate).alias("state")), "mix-state")
        _shared.forget(before)
        done += chunk
    return _shared.stored(flat, "mix-rates"), told


def weigh(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, n_tokens, p_poor, p_toxic, p_good, rate, copies."""
    rows = docs.select("doc_id", "text")
    rows = _shared.stored(posteriors(rows, fit(rows, labels, max_rows)), "mix-posteriors")
    cells = _shared.stored(rows.groupBy(*[f"p_{d}" for d in DOMAINS]).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    by_cell = rates(cells, targets, max_rate)[0].drop("tokens")  # one rate a distinct posterior: a bounded table
    rows = rows.join(F.broadcast(by_cell), [f"p_{d}" for d in DOMAINS])
    return rows.select("doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", copies().alias("copies"))


def copies() -> Column:
    u = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / (1 << 20)
    return F.floor(F.col("rate") + u).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs, all columns, each as often as its copies."""
    scored = _shared.stored(posteriors(docs, fit(docs, labels, max_rows)), "mix-posteriors")
    cells = _shared.stored(scored.groupBy(*[f"p_{d}" for d in DOMAINS]).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    by_cell = rates(cells, targets, max_rate)[0].drop("tokens")
    taken = scored.join(F.broadcast(by_cell), [f"p_{d}" for d in DOMAINS]).withColumn("copies", copies()).filter("copies > 0")
    key, text, times = (_shared.fresh(name, docs.columns) for name in ("mix_id", "mix_text", "mix_copies"))
    taken = taken.select(F.col("doc_id").alias(key), F.col("mix_hash").alias(text), F.col("copies").alias(times)).distinct()
    out = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(text)))
    if max_rate > 1:
        out = out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

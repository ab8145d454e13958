"""Group-relative statistics over sampled responses, and recurrences over token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import hash_sample

EPS = 1e-6


def with_group(df: DataFrame, uid: str, *aggregates: Column) -> DataFrame:
    """Adds aggregates of the row's group by an aggregation and a join, so that a hot group is combined before its shuffle."""
    return df.join(df.groupBy(uid).agg(*aggregates), uid)


def grpo(df: DataFrame, uid: str, score: str, scale: bool = True) -> DataFrame:
    g = with_group(df, uid, F.avg(score).alias("__m"), F.stddev_samp(score).alias("__s"), F.count("*").alias("__n"))
    mean = F.when(F.col("__n") == 1, 0.0).otherwise(F.col("__m"))
    std = F.when(F.col("__n") == 1, 1.0).otherwise(F.col("__s"))
    adv = (F.col(score) - mean) / (std + EPS) if scale else F.col(score) - mean
    return g.withColumn("advantage", adv).drop("__m", "__s", "__n")


def rloo(df: DataFrame, uid: str, score: str) -> DataFrame:
    g = with_group(df, uid, F.avg(score).alias("__m"), F.count("*").alias("__n"))
    n = F.col("__n")
    return g.withColumn("advantage", F.when(n == 1, F.col(score)).otherwise((F.col(score) - F.col("__m")) * n / (n - 1))).drop("__m", "__n")


def opo(df: DataFrame, uid: str, score: str, length: str) -> DataFrame:
    g = with_group(df, uid, (F.sum(F.col(length) * F.col(score)) / F.sum(length)).alias("__m"), F.count("*").alias("__n"))
    return g.withColumn("advantage", F.col(score) - F.when(F.col("__n") == 1, 0.0).otherwise(F.col("__m"))).drop("__m", "__n")


def best_gap(df: DataFrame, uid: str, score: str, tie: str) -> DataFrame:
    """The best of each group gets its lead over the second, the others 0; groups of one are an error upstream and get null."""
    w = W.partitionBy(uid).orderBy(F.desc(score), tie)
    r, second = F.row_number().over(w), F.lead(score).over(w)
    return df.withColumn("advantage", F.when(r == 1, F.col(score) - second).otherwise(0.0))


def informative(df: DataFrame, uid: str, score: str) -> DataFrame:
    """Rows of groups whose scores differ, or of one row."""
    g = with_group(df, uid, F.stddev_pop(score).alias("__s"), F.count("*").alias("__n"))
    return g.where((F.col("__s") > 0) | (F.col("__n") == 1)).drop("__s", "__n")


def masked_stats(df: DataFrame, value: str, mask: str) -> DataFrame:
    """Masked sum, mean and variance (by the mask's count less one)."""
    m, x = F.col(mask), F.col(value)
    s = df.where(m == 1).agg(F.sum(x).alias("total"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))
    return s


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reverse discounted sums, set back to 0 after a position whose mask is 0."""
    step = lambda acc, x: F.struct(F.concat(F.array(x["r"] + gamma * acc["run"]), acc["out"]).alias("out"), ((x["r"] + gamma * acc["run"]) * x["m"]).alias("run"))
    zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("run"))
    pairs = F.reverse(F.zip_with(rewards, mask, lambda r, m: F.struct(r.cast("double").alias("r"), m.cast("double").alias("m"))))
    return F.aggregate(pairs, zero, step)["out"]


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages by the reverse recurrence over whole sequences."""
    step = lambda acc, x: F.struct(
        F.concat(F.array(x["r"] + gamma * acc["next"] - x["v"] + gamma * lam * acc["adv"]), acc["out"]).alias("out"),
        (x["r"] + gamma * acc["next"] - x["v"] + gamma * lam * acc["adv"]).alias("adv"),
        x["v"].alias("next"),
    )
    zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("adv"), F.lit(0.0).alias("next"))
    pairs = F.reverse(F.zip_with(rewards, values, lambda r, v: F.struct(r.cast("double").alias("r"), v.cast("double").alias("v"))))
    return F.aggregate(pairs, zero, step)["out"]


def whiten(df: DataFrame, value: str, mask: str, shift_mean: bool = True) -> DataFrame:
    """value less the masked mean, over the masked deviation; one aggregation over the batch, joined as one row."""
    s = masked_stats(df, value, mask).select(F.col("mean").alias("__mean"), F.col("var").alias("__var"))
    out = (F.col(value) - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-8)
    joined = df.join(F.broadcast(s))  # a single row
    return joined.withColumn(value, out if shift_mean else out + F.col("__mean")).drop("__mean", "__var")


def baseline(df: DataFrame, uid: str, score: str) -> DataFrame:
    """The score less its group's mean; groups of one have the baseline 0."""
    return grpo(df, uid, score, scale=False)


def gpg(df: DataFrame, uid: str, score: str, scale: float = 1.0) -> DataFrame:
    """The baseline's advantage times rows over rows with a score other than 0."""
    total = df.agg((F.count("*") / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("__alpha"))
    return baseline(df, uid, score).join(F.broadcast(total)).withColumn("advantage", F.col("advantage") * F.col("__alpha") / scale).drop("__alpha")


def penalised(reward: Column, divergence: Column, coefficient: float) -> Column:
    return reward - coefficient * divergence


def next_coefficient(coefficient: float, divergence: float, target: float, steps: int, horizon: int) -> float:
    """The coefficient after a batch: moved in proportion to the error, of which at most a fifth counts."""
    error = min(max(divergence / target - 1, -0.2), 0.2)
    return coefficient * (1 + error * steps / horizon)


def aggregate_loss(tokens: DataFrame, seq: str, loss: str, mask: str, mode: str, width: int = 1) -> DataFrame:
    """One number over masked tokens: token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm (sum over width)."""
    x, m = F.col(loss) * F.col(mask), F.col(mask)
    if mode == "token-mean":
        return tokens.agg((F.sum(x) / F.sum(m)).alias("loss"))
    each = tokens.groupBy(seq).agg(F.sum(x).alias("__x"), F.sum(m).alias("__n"))
    total = {"seq-mean-token-sum": F.avg("__x"), "seq-mean-token-mean": F.avg(F.col("__x") / F.nullif(F.col("__n"), F.lit(0))), "seq-mean-token-sum-norm": F.sum("__x") / width}
    return each.agg(total[mode].alias("loss"))


def sequence_ratio(tokens: DataFrame, seq: str, logp: str, old: str, adv: str, mask: str, width: float = 0.2) -> DataFrame:
    """The clipped loss of each sequence by its geometric mean ratio, with the masked mean advantage."""
    m = F.col(mask)
    each = tokens.groupBy(seq).agg((F.sum((F.col(logp) - F.col(old)) * m) / F.greatest(F.sum(m), F.lit(1))).alias("d"), (F.sum(F.col(adv) * m) / F.greatest(F.sum(m), F.lit(1))).alias("a"))
    ratio = F.exp(F.least("d", F.lit(10.0)))
    return each.select(seq, F.greatest(-F.col("a") * ratio, -F.col("a") * F.least(F.greatest(ratio, F.lit(1 - width)), F.lit(1 + width))).alias("loss"))


def _batch_means(tokens: DataFrame, mask: str, *columns: str) -> list[float]:
    m = tokens.where(F.col(mask) > 0).agg(F.count("*"), *[F.avg(c) for c in columns]).first()
    return [x or 0.0 for x in m]


def clip_cov_loss(tokens: DataFrame, key: str, logp: str, old: str, adv: str, mask: str, width: float = 0.2, ratio: float = 0.0002, low: float = 1.0, high: float = 5.0, seed: str = "c") -> DataFrame:
    """Adds loss: the clipped loss, but 0 for a few masked tokens that clipping leaves alone and whose covariance of advantage and log probability lies between low and high.

    As many as a ratio of all masked tokens, one at least, drawn in the order of a hash of the key.
    """
    n, mean_adv, mean_logp = _batch_means(tokens, mask, adv, logp)
    r = F.exp(F.col(logp) - F.col(old))
    first, second = -F.col(adv) * r, -F.col(adv) * F.least(F.greatest(r, F.lit(1 - width)), F.lit(1 + width))
    cov = (F.col(adv) - mean_adv) * (F.col(logp) - mean_logp)
    open_ = tokens.where((F.col(mask) > 0) & (second <= first) & (cov > low) & (cov < high))
    drawn = hash_sample(open_.select(key), key, max(1, int(ratio * n)), seed).withColumn("__drawn", F.lit(True))
    return tokens.join(drawn, key, "left").withColumn("loss", F.when(F.col("__drawn"), 0.0).otherwise(F.greatest(first, second))).drop("__drawn")


def kl_cov_loss(tokens: DataFrame, key: str, logp: str, old: str, adv: str, mask: str, ratio: float = 0.0002, coefficient: float = 1.0) -> DataFrame:
    """Adds loss: the unclipped loss, with the absolute log ratio as a penalty for the masked tokens of largest covariance: a ratio of them, one at least; ties by key."""
    n, mean_adv, mean_logp = _batch_means(tokens, mask, adv, logp)
    d = F.col(logp) - F.col(old)
    cov = (F.col(adv) - mean_adv) * (F.col(logp) - mean_logp)
    top = tokens.where(F.col(mask) > 0).orderBy(F.round(cov, 9).desc(), key).limit(max(1, int(n * ratio))).select(key).withColumn("__top", F.lit(True))
    penalty = F.when(F.col("__top"), coefficient * F.abs(d)).otherwise(0.0)
    return tokens.join(top, key, "left").withColumn("loss", -F.col(adv) * F.exp(d) + penalty).drop("__top")


def geo_mean_loss(tokens: DataFrame, seq: str, logp: str, old: str, adv: str, mask: str, width: float = 0.2) -> DataFrame:
    """The loss of each sequence by the geometric mean of its ratios, each token clipped on the side that its advantage favours, and the masked mean advantage."""
    d, m = F.col(logp) - F.col(old), F.col(mask)
    clipped, sign = F.least(F.greatest(d, F.lit(-width)), F.lit(width)), F.signum(F.col(adv))
    each = tokens.groupBy(seq).agg(F.sum(sign * F.least(sign * d, sign * clipped) * m).alias("d"), F.sum(F.col(adv) * m).alias("a"), F.sum(m).alias("n"))
    n = F.col("n") + 1e-8
    return each.select(seq, (-F.col("a") / n * F.exp(F.col("d") / n)).alias("loss"))


def validation_metrics(df: DataFrame, source: str, prompt: str, value: str, vote: str, seq: str) -> DataFrame:
    """Per source, means over prompts of: mean and deviation of a prompt's N values, the expected best and worst of N draws with replacement, and the value of the majority's first vote.

    Expectations are exact, where resampling would estimate them. Of votes of one count the first by seq wins. Nulls of value are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(source, prompt, F.col(value).cast("double").alias("x"), F.col(vote).alias("v"), F.col(seq).alias("s"))
    # the values of one prompt: as many as there are responses
    each = rows.groupBy(source, prompt).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.sort_array(F.collect_list("x")).alias("xs"))
    n = F.size("xs").cast("double")
    chance = lambda i: F.pow((i + 1) / n, n) - F.pow(i / n, n)
    expected = lambda xs: F.aggregate(F.transform(xs, lambda x, i: x * chance(i)), F.lit(0.0), lambda a, b: a + b)
    each = each.withColumn("best", expected(F.col("xs"))).withColumn("worst", expected(F.reverse("xs"))).drop("xs")
    votes = rows.groupBy(source, prompt, "v").agg(F.count("*").alias("c"), F.min(F.struct("s", "x")).alias("first"))
    most = votes.groupBy(source, prompt).agg(F.min(F.struct((-F.col("c")).alias("c"), "first")).alias("m")).select(source, prompt, F.col("m.first.x").alias("maj"))
    return each.join(most, [source, prompt]).groupBy(source).agg(*[F.avg(c).alias(c) for c in ("mean", "std", "best", "worst", "maj")])


def bootstrap(df: DataFrame, group: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """Mean and deviation of resampled means of each group: every row gets a Poisson weight in each draw, so nothing is joined or collected.

    Weights come from a hash of seed, draw, group and value position columns, so a rerun agrees.
    """
    u = lambda b: (F.xxhash64(F.lit(seed), F.lit(b), *[F.col(c) for c in df.columns]) / F.lit(2.0**64) + 0.5)
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = lambda b: sum(F.when(u(b) > c, 1).otherwise(0) for c in cuts)
    sums = [x for b in range(draws) for x in (F.sum(weight(b) * F.col(value)).alias(f"s{b}"), F.sum(weight(b)).alias(f"w{b}"))]
    means = F.array_compact(F.array(*[F.col(f"s{b}") / F.nullif(F.col(f"w{b}"), F.lit(0)) for b in range(draws)]))
    each = df.groupBy(group).agg(*sums).select(group, F.explode(means).alias("m"))
    return each.groupBy(group).agg(F.avg("m").alias("mean"), F.coalesce(F.stddev_pop("m"), F.lit(0.0)).alias("std"))


def resampled(df: DataFrame, key: str, score: str, power: float = 1.0, seed: int = 0) -> DataFrame:
    """(key, taken): how often each row is drawn when as many rows are drawn with weights |score| to a power.

    Systematic draws: the running weight is cut at n equal steps from a hashed
    start, by ranges of a hash of the key, so no row set meets in one task.
    """
    from .ordering import row_index

    w = df.select(key, (F.abs(F.col(score)) ** power).alias("w"))
    n, total = w.agg(F.count("*"), F.sum("w")).first()
    if not n or not total:
        return w.select(key, F.lit(1 if n else 0).cast("long").alias("taken"))
    ranked = row_index(w.withColumn("h", F.xxhash64(F.lit(seed), F.col(key))), "h", key)
    block = F.floor(F.col("idx") / (1 << 16))
    per = ranked.groupBy(block.alias("__b")).agg(F.sum("w").alias("__w"))
    before = per.select("__b", (F.sum("__w").over(W.orderBy("__b")) - F.col("__w")).alias("__before"))
    own = F.sum("w").over(W.partitionBy("__b").orderBy("idx"))
    end = F.col("__before") + F.col("__own")
    joined = ranked.withColumn("__b", block).withColumn("__own", own).join(before, "__b")
    steps = lambda x: F.ceil(x * F.lit(n / total) - 0.5)
    return joined.select(key, F.greatest(steps(end) - steps(end - F.col("w")), F.lit(0)).cast("long").alias("taken"))


def resampling_weights(df: DataFrame, score: str, method: str = "pow", power: float = 2.0, name: str = "weight") -> DataFrame:
    """Adds the weight of each row: |score| to a power (pow), 1 for the greatest and the smallest score and else 0 (max_min), or 0.4 for the greatest and else 0.1 (max_random)."""
    if method == "pow":
        return df.withColumn(name, F.abs(F.col(score)) ** power)
    if method not in ("max_min", "max_random"):
        raise ValueError(f"no such method: {method}")
    ends = df.agg(F.max(score).alias("__most"), F.min(score).alias("__least"))  # one row
    held = df.join(F.broadcast(ends))
    at_most, at_least = F.col(score) == F.col("__most"), F.col(score) == F.col("__least")
    weight = F.when(at_most | at_least, 1.0).otherwise(0.0) if method == "max_min" else F.when(at_most, 0.4).otherwise(0.1)
    return held.withColumn(name, weight).drop("__most", "__least")


def drawn(df: DataFrame, key: str, weight: str, n: int | None = None, seed: int = 0, cell: int = 1 << 16) -> DataFrame:
    """(key, taken): how often each row is taken in n independent draws with replacement by weight; as many draws as rows, if not given.

    Rows lie on a line, each as long as its weight, in the order of a hash of
    the key; a draw is a point, from a hash of its number. The line is cut into
    cells of about ``cell`` draws, and in each cell draws meet the rows whose
    piece they fall into in one pass in order. A row that is longer than cells
    starts anew in each. Null, negative and non-finite weights count as 0;
    without any weight nothing is taken. Keys are distinct. Reruns agree.
    """
    from .ordering import materialise, row_index

    w = F.when((F.col(weight) > 0) & (F.col(weight) < float("inf")), F.col(weight).cast("double")).otherwise(0.0)
    every = df.select(F.col(key).alias("key"), w.alias("w"))
    n = every.count() if n is None else n
    ranked = row_index(every.where("w > 0").withColumn("h", F.xxhash64(F.lit(seed), F.col("key").cast("string"))), "h", "key")
    ranked = ranked.select("key", "w", "idx", F.floor(F.col("idx") / cell).alias("block"))
    per = ranked.groupBy("block").agg(F.sum("w").alias("sum"))  # a row for each block of rows
    before = per.select("block", (F.sum("sum").over(W.orderBy("block")) - F.col("sum")).alias("before"))
    own = F.sum("w").over(W.partitionBy("block").orderBy("idx")) - F.col("w")
    line = materialise(ranked.select("key", "w", "idx", "block", own.alias("own")).join(F.broadcast(before), "block").select("key", "idx", "w", (F.col("before") + F.col("own")).alias("start")))
    total = line.agg(F.max(F.col("start") + F.col("w"))).first()[0]
    if not total or not n:
        return every.select(F.col("key").alias(key), F.lit(0).cast("long").alias("taken"))
    cells = max(1, -(-n // cell))
    of = lambda c: F.least(F.floor(c / F.lit(total) * cells), F.lit(cells - 1)).cast("long")
    points = df.sparkSession.range(n).select(((F.xxhash64(F.lit(seed), F.lit("draw"), "id") / F.lit(2.0**64) + 0.5) * F.lit(total)).alias("at"))
    points = points.select(of(F.col("at")).alias("cell"), "at", F.lit(1).alias("draw"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast(every.schema["key"].dataType).alias("key"))
    pieces = line.select("key", "idx", "start", F.explode(F.sequence(of(F.col("start")), of(F.col("start") + F.col("w")))).alias("cell"))
    pieces = pieces.select("cell", F.col("start").alias("at"), F.lit(0).alias("draw"), "idx", "key")
    hit = F.last("key", True).over(W.partitionBy("cell").orderBy("at", "draw", F.col("idx")).rowsBetween(W.unboundedPreceding, 0))
    counts = points.unionByName(pieces).withColumn("hit", hit).where("draw = 1").groupBy("hit").agg(F.count("*").alias("taken"))
    return every.join(counts, every["key"] == counts["hit"], "left").select(every["key"].alias(key), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

"""Cleaning, encoding, scaling, splitting and balancing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.scan import column_quantiles, running_sums, slice_count
from riskloom.session import cut_lineage

DATE_COLUMNS = ("issue_date", "last_payment_date", "next_payment_date", "earliest_credit_line")


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def merge_text(loans: DataFrame, text: DataFrame, on: str = "loan_id", suffix: str = "_text") -> DataFrame:
    """Left join; columns both sides have get a suffix on the right."""
    clash = set(loans.columns) - {on}
    right = text.select(on, *[F.col(c).alias(c + suffix if c in clash else c) for c in text.columns if c != on])
    return loans.join(right, on, "left")


def median_fill(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in column_quantiles(df, cols, [0.5]).items()}


def impute_median(df: DataFrame, cols: Sequence[str], medians: dict[str, float | None] | None = None) -> DataFrame:
    """NULL and NaN become the column median."""
    medians = median_fill(df, cols) if medians is None else medians
    return df.withColumns(
        {
            c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m))
            for c, m in medians.items()
            if m is not None
        }
    )


def impute_constant(df: DataFrame, cols: Sequence[str] | None = None, value: str = "Unknown") -> DataFrame:
    return df.fillna(value, subset=list(cols if cols is not None else string_columns(df)))


def iqr_fences(df: DataFrame, cols: Sequence[str], factor: float = 3.0) -> dict[str, tuple[float, float]]:
    out = {}
    for c, (q1, q3) in column_quantiles(df, cols, [0.25, 0.75]).items():
        if q1 is not None:
            out[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def clip_iqr(
    df: DataFrame, cols: Sequence[str], factor: float = 3.0, fences: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Limit each column to its quartile fences; rows are kept, label and ids are not touched."""
    fences = iqr_fences(df, cols, factor) if fences is None else fences
    limited = {}
    for c, (lo, hi) in fences.items():
        x = F.col(c).cast("double")
        limited[c] = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))
    return df.withColumns(limited)


def code_table(df: DataFrame, col: str, code: str = "__code") -> DataFrame:
    """(value, code): codes from 0 in sorted order of the distinct values, NULL as its own text.

    The distinct values are range-partitioned, written once, and numbered per partition plus an
    offset, however many there are.
    """
    values = df.select(F.coalesce(F.col(col).cast("string"), F.lit("None")).alias(col)).distinct()
    parted = cut_lineage(
        values.repartitionByRange(col).sortWithinPartitions(col).withColumn("__pid", F.spark_partition_id())
    )
    sizes = parted.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy("__pid").orderBy(col)) - 1
    return parted.withColumn("__k", local).join(F.broadcast(starts), "__pid").select(
        col, (F.col("__k") + F.col("__start")).alias(code)
    )


def apply_codes(df: DataFrame, col: str, table: DataFrame, unseen: int | None = -1) -> DataFrame:
    key = df.withColumn("__key", F.coalesce(F.col(col).cast("string"), F.lit("None")))
    codes = table.withColumnRenamed(col, "__key")
    joined = key.join(codes, "__key", "left")
    value = F.col("__code").cast("int")
    value = F.coalesce(value, F.lit(unseen)) if unseen is not None else value
    return joined.select(*[value.alias(c) if c == col else F.col(c) for c in df.columns])


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = apply_codes(df, c, code_table(df, c), unseen=None)
    return df


def ordinal_encode(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Codes fitted on `train`; values it has not seen become -1."""
    for c in cols:
        df = apply_codes(df, c, code_table(train, c), unseen=-1)
    return df


def scale_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)],
    ).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"] or 1.0) for i, c in enumerate(cols) if row[f"m_{i}"] is not None}


def standard_scale(
    df: DataFrame, cols: Sequence[str], stats: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    stats = scale_stats(df, cols) if stats is None else stats
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def yeo_johnson(x: Column, lam: float) -> Column:
    pos = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def power_lambdas(df: DataFrame, cols: Sequence[str], lo: float = -2.0, hi: float = 2.0, rounds: int = 3) -> dict[str, float]:
    """Lambda of highest log-likelihood per column, by a grid that is refined twice.

    Every round is one aggregate: likelihoods of all grid values of all columns at once.
    """
    grids = {c: [lo + (hi - lo) * i / 20 for i in range(21)] for c in cols}
    best: dict[str, float] = {}
    step = (hi - lo) / 20
    for _ in range(rounds):
        aggs = []
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            aggs += [F.count(x).alias(f"n_{i}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"g_{i}")]
            aggs += [F.var_pop(yeo_johnson(x, g)).alias(f"v_{i}_{j}") for j, g in enumerate(grids[c])]
        row = df.agg(*aggs).first()
        for i, c in enumerate(cols):
            import math

            def score(j: int) -> float:
                v = row[f"v_{i}_{j}"]
                if not v or v <= 0 or math.isnan(v) or math.isinf(v):
                    return -math.inf
                return -row[f"n_{i}"] / 2 * math.log(v) + (grids[c][j] - 1) * row[f"g_{i}"]

            best[c] = grids[c][max(range(len(grids[c])), key=score)]
        grids = {c: [best[c] - step + step * k / 10 for k in range(21)] for c in cols}
        step /= 10
    return best


def power_transform(df: DataFrame, cols: Sequence[str], lambdas: dict[str, float] | None = None) -> DataFrame:
    """Yeo-Johnson with fitted lambda, then standardise."""
    lambdas = power_lambdas(df, cols) if lambdas is None else lambdas
    bent = df.withColumns({c: yeo_johnson(F.col(c).cast("double"), lam) for c, lam in lambdas.items()})
    return standard_scale(bent, list(lambdas))


def date_parts(df: DataFrame, cols: Sequence[str] = DATE_COLUMNS) -> DataFrame:
    """Year, month, day and weekday (Monday 0) instead of the date column."""
    for c in [c for c in cols if c in df.columns]:
        ts = F.col(c)
        if isinstance(df.schema[c].dataType, T.StringType):
            ts = F.try_to_timestamp(ts)
        df = df.withColumns(
            {
                f"{c}_year": F.year(ts),
                f"{c}_month": F.month(ts),
                f"{c}_day": F.dayofmonth(ts),
                f"{c}_dayofweek": F.weekday(ts),
            }
        ).drop(c)
    return df


@dataclass
class Preprocessor:
    """Impute, expand dates, clip and encode with state fitted once.

    The state is small: a median and two fences per column, and a code table per
    categorical column.
    """

    label: str = "default_status"
    ids: tuple[str, ...] = ("loan_id",)
    factor: float = 3.0
    medians: dict[str, float | None] = field(default_factory=dict)
    fences: dict[str, tuple[float, float]] = field(default_factory=dict)
    codes: dict[str, DataFrame] = field(default_factory=dict)
    fitted: bool = False

    def _skip(self) -> tuple[str, ...]:
        return (self.label, *self.ids)

    def fit(self, df: DataFrame) -> "Preprocessor":
        nums, cats = numeric_columns(df, self._skip()), string_columns(df, self._skip())
        self.medians = median_fill(df, nums)
        filled = date_parts(impute_constant(impute_median(df, nums, self.medians), cats))
        self.fences = iqr_fences(filled, numeric_columns(filled, self._skip()), self.factor)
        self.codes = {c: code_table(filled, c) for c in cats}
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("fit the preprocessor before transform")
        out = impute_median(df, list(self.medians), self.medians)
        out = date_parts(impute_constant(out, list(self.codes)))
        out = clip_iqr(out, list(self.fences), fences=self.fences)
        for c, table in self.codes.items():
            out = apply_codes(out, c, table, unseen=-1)
        return out

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def unit_hash(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends only on the keys and the seed."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def stratified_split(
    df: DataFrame, y: str, key: str, shares: Sequence[tuple[str, float]] = (("train", 0.65), ("val", 0.15), ("test", 0.2)),
    seed: int = 42, out: str = "part",
) -> DataFrame:
    """Exact shares per class: rows of a class are ranked by a hash of their key.

    The ranks are running counts over slices of the hash, per class, so a class that holds
    most rows is not ranked on one task.
    """
    hashed = df.withColumn("__h", unit_hash(seed, key)).withColumn("__one", F.lit(1))
    n = slice_count(df.sparkSession)
    cuts = [i / n for i in range(1, n)]
    ranked = running_sums(hashed, "__h", ["__one"], by=[y], cuts=cuts, tie=[key])
    share = F.col("__one_run") / F.col("__one_all")
    limit, chain = 0.0, None
    for name, s in shares[:-1]:
        limit += s
        cond = share <= F.lit(limit + 1e-12)
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    label = chain.otherwise(shares[-1][0]) if chain is not None else F.lit(shares[-1][0])
    return ranked.select(*df.columns, label.alias(out))


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, out: str = "fold", y: str | None = None) -> DataFrame:
    """Fold number from a hash of the key, the same for every plan. With a label `y` the rows of
    each class are dealt out in the order of the hash, so a class has the same number of rows in
    every fold, or one more; without, no shuffle is needed and folds are even in expectation."""
    if y is None:
        return df.withColumn(out, F.floor(unit_hash(seed, key) * k).cast("int"))
    hashed = df.withColumn("__h", unit_hash(seed, key)).withColumn("__one", F.lit(1))
    n = slice_count(df.sparkSession)
    ranked = running_sums(hashed, "__h", ["__one"], by=[y], cuts=[i / n for i in range(1, n)], tie=[key])
    return ranked.select(*df.columns, ((F.col("__one_run") - 1) % k).cast("int").alias(out))


def replace_nonfinite(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """NULL, NaN and infinite numbers become 0."""
    out = {}
    for f in df.schema.fields:
        if f.name in skip or not isinstance(f.dataType, T.NumericType):
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            odd = F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull()
            out[f.name] = F.when(odd, F.lit(0.0).cast(f.dataType)).otherwise(c)
        else:
            out[f.name] = F.coalesce(c, F.lit(0).cast(f.dataType))
    return df.withColumns(out)


def class_weights(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_class); NULL labels get no weight."""
    sizes = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n")).limit(1001).collect()
    if len(sizes) > 1000:
        raise ValueError(f"{y} has more than 1000 classes")
    counts = {r[y]: r["n"] for r in sizes}
    total, k = sum(counts.values()), len(counts)
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(y) == F.lit(value), F.lit(total / (k * n))).otherwise(weight)
    return df.withColumn(out, weight)


def oversample(
    df: DataFrame, y: str, key: str, cols: Sequence[str], ratio: float = 1.0, k: int = 5, seed: int = 42,
) -> DataFrame:
    """SMOTE: synthetic minority rows between a row and one of its k nearest minority rows.

    Neighbours come from `neighbours.nearest_neighbours` on the standardised columns (random
    projections in several tables, hot buckets cut again, top k by true distance). The minority
    class is the one with fewest labelled rows (ties: the smaller label), the majority the one with
    most. Rows of the minority class that miss a feature (NULL or NaN) have no neighbours; the
    others make up for them, and if all of them miss one it is an error. `missing` = floor(ratio x
    majority) - minority rows are made: each complete minority row makes floor(missing / n) rows,
    and one more where its key's fraction `key_fraction` is below the remainder share, so counts
    are known to SQL. A synthetic row is its row plus a hashed share in [0, 1) of the way to a
    hashed one of its neighbours; a row without neighbours is copied. Rows without a label are of
    no class. Returns the original rows and the synthetic rows (`key` NULL, `synthetic` true).
    """
    from riskloom.operators.neighbours import nearest_neighbours

    full = F.lit(True)
    for c in cols:
        full &= F.col(c).isNotNull() & ~F.isnan(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    sizes = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(full & F.col(key).isNotNull(), 1)).alias("n_full"))
    least = sizes.orderBy("n", y).first()
    base = df.withColumn("synthetic", F.lit(False))
    if least is None:
        return base
    most = sizes.orderBy(F.desc("n"), y).first()
    low, missing = least[y], int(ratio * most["n"]) - least["n"]
    if missing <= 0:
        return base
    if not least["n_full"]:
        raise ValueError(f"every row of class {low} misses one of {list(cols)}: impute first")
    whole, rest = divmod(missing, least["n_full"])
    minority = df.where((F.col(y) == F.lit(low)) & full & F.col(key).isNotNull())
    stats = scale_stats(minority, cols)
    scaled = minority.select(F.col(key), *[((F.col(c).cast("double") - stats[c][0]) / stats[c][1]).alias(f"__z{i}") for i, c in enumerate(cols)])
    near = nearest_neighbours(scaled, key, [f"__z{i}" for i in range(len(cols))], k=k, seed=seed)
    values = F.array(*[F.col(c).cast("double") for c in cols])
    copies = F.lit(whole) + F.when(key_fraction(F.col(key)) < F.lit(rest / least["n_full"]), 1).otherwise(0)
    drawn = minority.join(near, key).withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int")))))
    pool = F.col("neighbours.key")
    chosen = F.try_element_at(pool, (F.pmod(F.xxhash64(F.col(key), F.col("__copy"), F.lit(seed)), F.greatest(F.size(pool), F.lit(1))) + 1).cast("int"))
    gap = F.pmod(F.xxhash64(F.col("__copy"), F.col(key), F.lit(seed + 2)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    made = drawn.withColumn("__other", chosen).withColumn("__gap", gap)
    partner = minority.groupBy(F.col(key).alias("__other")).agg(F.first(values).alias("__pick"))
    made = made.join(partner, "__other", "left").withColumn("__pick", F.coalesce("__pick", values))
    types = dict(df.dtypes)
    synth = made.select(
        *[
            F.lit(None).cast(types[c]).alias(c)
            if c == key
            else (F.col(c) + F.col("__gap") * (F.col("__pick")[cols.index(c)] - F.col(c))).cast(types[c]).alias(c)
            if c in cols
            else F.col(c)
            for c in df.columns
        ],
        F.lit(True).alias("synthetic"),
    )
    return base.unionByName(synth)


def key_fraction(key: Column) -> Column:
    """A number in [0, 1) from an integer key by a multiplicative hash that SQL engines share:
    ((key mod 2^32) * 1540483477 mod 2^32) / 2^32."""
    m = F.lit(1 << 32)
    return F.pmod(F.pmod(key.cast("long"), m) * F.lit(1540483477), m) / F.lit(float(1 << 32))

"""Price models behind one interface: fit on a feature table, score a feature table.

The forest is pyspark.ml's, on an assembled vector; boosted trees are those of `boosting`. The
per-period linear model and the small neural net are grouped pandas functions over bounded
groups: a period's days, one training set.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import filled, signed_exp, signed_log
from ..session import ship
from .boosting import BoostedModel


@dataclass
class TreeModel:
    """A tree ensemble on the signed logarithm of the price."""

    columns: list[str]
    regressor: object
    fitted: PipelineModel | None = None

    def fit(self, df: DataFrame) -> TreeModel:
        data = filled(df, self.columns).withColumn("label", signed_log(F.col("spot")))
        self.fitted = Pipeline(stages=[VectorAssembler(inputCols=self.columns, outputCol="features"), self.regressor]).fit(data)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.fitted.transform(filled(df, self.columns)).withColumn("prediction", signed_exp(F.col("prediction")))
        return scored.drop("features", "rawPrediction")

    def importances(self) -> list[tuple[str, float]]:
        """Falling."""
        return sorted(zip(self.columns, self.fitted.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def lars_path(x: np.ndarray, y: np.ndarray, max_steps: int = 500):
    """Lasso solutions at the knots of the least-angle path, for standardised columns."""
    n, p = x.shape
    beta, active = np.zeros(p), []
    yield beta.copy()
    for _ in range(min(max_steps, 8 * min(n, p))):
        corr = x.T @ (y - x @ beta)
        if not active:
            top = np.abs(corr).max()
            if top < 1e-10:
                return
            active = [int(np.argmax(np.abs(corr)))]
        level = max(np.abs(corr[active]).max(), 0.0)
        if level < 1e-8 * n:
            return
        sign = np.sign(corr[active])
        try:
            direction = np.linalg.solve(x[:, active].T @ x[:, active] + 1e-10 * n * np.eye(len(active)), sign)
        except np.linalg.LinAlgError:
            return
        along = x.T @ (x[:, active] @ direction)
        step, enter, leave = level, None, None
        for j in range(p):
            if j in active:
                continue
            for s in (1, -1):
                bottom = 1 - s * along[j]
                if bottom > 1e-12:
                    g = (level - s * corr[j]) / bottom
                    if 1e-12 < g < step:
                        step, enter, leave = g, j, None
        for k, j in enumerate(active):
            if direction[k] * beta[j] < 0:
                g = -beta[j] / direction[k]
                if 1e-12 < g < step:
                    step, enter, leave = g, None, j
        beta[active] += step * direction
        if leave is not None:
            beta[leave] = 0.0
            active.remove(leave)
        elif enter is not None:
            if len(active) >= n - 1:
                yield beta.copy()
                return
            active.append(enter)
        yield beta.copy()
        if enter is None and leave is None:
            return


def fit_lasso(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """The Lasso of least AIC on its path, in the columns' own units: weights and intercept."""
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 0, std, 1.0)
    z, centre = (x - mean) / std, y.mean()
    n = len(y)
    noise = max(np.var(y), 1e-12)
    best, least = np.zeros(x.shape[1]), np.inf
    for beta in lars_path(z, y - centre):
        k = int((np.abs(beta) > 1e-12).sum())
        rss = float(((y - centre - z @ beta) ** 2).sum())
        aic = n * np.log(max(rss, 1e-9 * noise * n) / n) + 2 * k
        if aic < least:
            best, least = beta, aic
    w = best / std
    return w, float(centre - mean @ w)


@dataclass
class PeriodLinearModel:
    """One sparse linear model for each half-hour; a period of under `least` rows has none and
    predicts 0."""

    columns: list[str]
    least: int = 30
    weights: DataFrame | None = None

    def fit(self, df: DataFrame) -> PeriodLinearModel:
        columns, least = self.columns, self.least

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            out = {"settlement_period": [], "weights": [], "intercept": []}
            if len(rows) >= least:
                y = rows["spot"].to_numpy(float)
                w, b = fit_lasso(rows[columns].to_numpy(float), np.sign(y) * np.log1p(np.abs(y)))
                out = {"settlement_period": [rows["settlement_period"].iloc[0]], "weights": [w.tolist()], "intercept": [b]}
            return pd.DataFrame(out).astype({"weights": object})

        ship(df.sparkSession)
        data = filled(df, columns).select("settlement_period", "spot", *columns)
        self.weights = data.groupBy("settlement_period").applyInPandas(one, "settlement_period int, weights array<double>, intercept double").persist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns))
        dot = F.aggregate(F.zip_with(x, F.col("weights"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        out = df.join(F.broadcast(self.weights), "settlement_period", "left")  # 50 rows
        return out.withColumn("prediction", F.coalesce(signed_exp(dot + F.col("intercept")), F.lit(0.0))).drop("weights", "intercept")

    def importances(self) -> list[tuple[str, float]]:
        """Mean absolute weight over the periods, falling."""
        w = self.weights.select(F.posexplode("weights").alias("i", "w")).groupBy("i").agg(F.avg(F.abs("w")).alias("w")).collect()
        return sorted(((self.columns[r["i"]], r["w"]) for r in w), key=lambda x: (-x[1], x[0]))


@dataclass
class NeuralModel:
    """A multilayer perceptron in NumPy: rectified layers, Adam, early stopping on the last
    tenth of the days. A training set of up to `shard_rows` rows is fitted in one process. A
    larger one is dealt by hash into shards of about that many: every epoch each shard trains
    from the common weights in a task of its own, and the weights are averaged by rows. All
    rows are used at any size."""

    columns: list[str]
    layers: tuple[int, ...] = (512, 256, 128, 64)
    epochs: int = 200
    patience: int = 15
    batch: int = 512
    dropout: float = 0.15
    rate: float = 1e-3
    seed: int = 42
    shard_rows: int = 100_000
    state: list = field(default_factory=list)

    def fit(self, df: DataFrame) -> NeuralModel:
        data = filled(df, self.columns).select("settlement_date", signed_log(F.col("spot")).alias("label"), *self.columns).where("label is not null")
        n = data.count()
        self.state = self._fit_here(data) if n <= self.shard_rows else self._fit_shards(data, -(-n // self.shard_rows))
        return self

    def _fit_here(self, data: DataFrame) -> list:
        rows = data.toPandas().sort_values("settlement_date", kind="stable")  # `shard_rows` rows at most
        return train_network(rows[self.columns].to_numpy(float), rows["label"].to_numpy(float), self)

    def _fit_shards(self, data: DataFrame, shards: int) -> list:
        ship(data.sparkSession)
        sizes = data.groupBy("settlement_date").agg(F.count("*").alias("n")).orderBy("settlement_date").collect()  # a row a day
        upto = np.cumsum([r["n"] for r in sizes])
        last = sizes[min(int(np.searchsorted(upto, 0.9 * upto[-1])), len(sizes) - 1)]["settlement_date"]
        data = data.withColumns({"held": F.col("settlement_date") > F.lit(last), "shard": F.pmod(F.xxhash64(*data.columns), F.lit(shards))}).persist()
        stats = data.where("not held").agg(F.avg("label"), *(f(c) for c in self.columns for f in (F.avg, F.stddev_pop))).first()
        mean, std = np.array(stats[1::2], float), np.array(stats[2::2], float)
        std = np.where(std > 0, std, 1.0)
        weights = new_weights(np.random.default_rng(self.seed), [len(self.columns), *self.layers, 1], stats[0])
        columns, batch, dropout, seed = self.columns, self.batch, self.dropout, self.seed
        best, stop = None, EarlyStop(self.patience, self.rate)
        for epoch in range(self.epochs):
            shared = data.sparkSession.sparkContext.broadcast((mean, std, weights))
            rate = stop.rate

            def one(rows: pd.DataFrame) -> pd.DataFrame:
                mean, std, w = shared.value
                held = rows["held"].to_numpy(bool)
                z, y = (rows[columns].to_numpy(float) - mean) / std, rows["label"].to_numpy(float)
                lost = float(((run_network(rows[columns].to_numpy(float)[held], [mean, std, w]) - y[held]) ** 2).sum())
                w = [[a.copy(), b.copy()] for a, b in w]
                rng = np.random.default_rng((seed, epoch, int(rows["shard"].iloc[0])))
                train_epoch(z[~held], y[~held], w, zero_moments(w), 0, rng, batch, dropout, rate)
                flat = np.concatenate([x.ravel() for layer in w for x in layer])
                return pd.DataFrame({"n": [int((~held).sum())], "held": [int(held.sum())], "lost": [lost], "weights": [flat.astype("<f8").tobytes()]})

            total, flat, lost, n_held = 0, 0.0, 0.0, 0
            for r in data.groupBy("shard").applyInPandas(one, "n bigint, held bigint, lost double, weights binary").toLocalIterator():
                total, flat = total + r["n"], flat + r["n"] * np.frombuffer(r["weights"], "<f8")
                lost, n_held = lost + r["lost"], n_held + r["held"]
            before, weights, at = weights, [], 0
            for layer in before:
                weights.append([])
                for x in layer:
                    weights[-1].append((flat[at : at + x.size] / max(total, 1)).reshape(x.shape))
                    at += x.size
            better, done = stop.seen(lost / max(n_held, 1))  # of the weights that the epoch began with
            best = before if better or best is None else best
            if done:
                break
        data.unpersist()
        return [mean, std, best]

    def predict(self, df: DataFrame) -> DataFrame:
        state, columns = self.state, self.columns
        ship(df.sparkSession)

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            z = run_network(x[columns].to_numpy(float), state)
            return pd.Series(np.sign(z) * np.expm1(np.abs(z)))

        filled = F.struct(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
        return df.withColumn("prediction", score(filled))

    def importances(self) -> list[tuple[str, float]]:
        return [(c, 0.0) for c in self.columns]


def run_network(x: np.ndarray, state: list) -> np.ndarray:
    mean, std, weights = state
    h = (x - mean) / std
    for i, (w, b) in enumerate(weights):
        h = h @ w + b
        if i < len(weights) - 1:
            h = np.maximum(h, 0.0)
    return h[:, 0]


def new_weights(rng, sizes: list[int], bias: float) -> list:
    weights = [[rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in zip(sizes, sizes[1:])]
    weights[-1][1][:] = bias
    return weights


def zero_moments(weights: list) -> list:
    return [[np.zeros_like(p) for p in layer for _ in (0, 1)] for layer in weights]


def train_epoch(z: np.ndarray, y: np.ndarray, weights: list, moments: list, t: int, rng, batch: int, dropout: float, rate: float) -> int:
    """One pass of Adam over the rows in random batches, in place; the steps done so far."""
    order = rng.permutation(len(z))
    for a in range(0, len(z), batch):
        at = order[a : a + batch]
        acts, masks = [z[at]], []
        for i, (w, b) in enumerate(weights):
            h = acts[-1] @ w + b
            if i < len(weights) - 1:
                mask = (h > 0) * (rng.random(h.shape) >= dropout) / (1 - dropout)
                h = h * mask
                masks.append(mask)
            acts.append(h)
        grad = 2 * (acts[-1] - y[at][:, None]) / len(at)
        t += 1
        for i in range(len(weights) - 1, -1, -1):
            g = [acts[i].T @ grad, grad.sum(0)]
            if i:
                grad = (grad @ weights[i][0].T) * masks[i - 1]
            for k in (0, 1):
                m1, m2 = moments[i][2 * k], moments[i][2 * k + 1]
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.001 * (g[k] ** 2 - m2)
                weights[i][k] -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return t


@dataclass
class EarlyStop:
    """Halves the rate after six epochs without a better loss, and stops after `patience`."""

    patience: int
    rate: float
    least: float = np.inf
    waited: int = 0
    stale: int = 0

    def seen(self, loss: float) -> tuple[bool, bool]:
        """Whether the loss is the best so far, and whether to stop."""
        if loss < self.least - 1e-9:
            self.least, self.waited, self.stale = loss, 0, 0
            return True, False
        self.waited, self.stale = self.waited + 1, self.stale + 1
        if self.stale > 5:
            self.rate, self.stale = self.rate * 0.5, 0
        return False, self.waited >= self.patience


def train_network(x: np.ndarray, y: np.ndarray, m: NeuralModel) -> list:
    rng = np.random.default_rng(m.seed)
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 0, std, 1.0)
    cut = max(1, int(0.9 * len(x)))
    z, held = (x[:cut] - mean) / std, x[cut:]
    weights = new_weights(rng, [x.shape[1], *m.layers, 1], y[:cut].mean() if cut else 0.0)
    moments, t, best, stop = zero_moments(weights), 0, None, EarlyStop(m.patience, m.rate)
    for _ in range(m.epochs):
        t = train_epoch(z, y[:cut], weights, moments, t, rng, m.batch, m.dropout, stop.rate)
        now = [mean, std, [(w.copy(), b.copy()) for w, b in weights]]
        better, done = stop.seen(float(((run_network(held, now) - y[cut:]) ** 2).mean()) if len(held) else 0.0)
        best = now if better or best is None else best
        if done:
            break
    return best


def build(kind: str, columns: list[str], **options):
    """A model by name: rf, xgb and lgb are tree ensembles, lear the per-period linear model,
    dnn the neural net."""
    if kind == "rf":
        r = RandomForestRegressor(numTrees=300, maxDepth=14, featureSubsetStrategy="0.5", minInstancesPerNode=5, seed=42, subsamplingRate=1.0)
    elif kind == "xgb":
        return BoostedModel(columns, **{"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "minInstancesPerNode": 3, "l1": 0.05, "l2": 1.0} | options)
    elif kind == "lgb":
        return BoostedModel(columns, **{"maxIter": 500, "maxDepth": None, "leaves": 63, "stepSize": 0.03, "minInstancesPerNode": 20, "l1": 0.05} | options)
    elif kind == "lear":
        return PeriodLinearModel(columns, **options)
    elif kind == "dnn":
        return NeuralModel(columns, **options)
    else:
        raise ValueError(f"unknown model {kind}")
    for k, v in options.items():
        r = r._set(**{k: v})
    return TreeModel(columns, r)

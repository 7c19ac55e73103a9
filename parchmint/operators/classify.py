"""Which mail is a newsletter: rules, a trained classifier, and the upkeep of its examples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import text
from parchmint.functions.mail import domain_of
from parchmint.staging import file_system, staged

# The domain lists every vault starts with.
PLATFORMS = ["substack.com", "beehiiv.com", "convertkit.com", "buttondown.email", "ghost.io", "mailchimp.com", "sendfox.com", "hubspotemail.net", "revue.email"]
PROMOTIONS = ["klaviyomail.com", "shopifyemail.com"]
LEAST_WORDS = 500
KEEP, SKIP = "KEEP", "SKIP"


def domain_lists(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """(list, domain, origin): both tables of (list, domain), trimmed and lower-cased; a default stays one."""
    rows = defaults.select("list", "domain", F.lit(0).alias("rank")).unionByName(own.select("list", "domain", F.lit(1).alias("rank")))
    tidy = rows.withColumn("domain", F.lower(F.trim("domain"))).where("domain <> ''")
    best = tidy.groupBy("list", "domain").agg(F.min("rank").alias("rank"))
    return best.select("list", "domain", F.when(F.col("rank") == 0, "bundled").otherwise("user").alias("origin"))


def _ends_with_any(domain: Column, domains: list[str]) -> Column:
    found = F.lit(False)
    for d in domains:
        found = found | domain.endswith(d)
    return F.coalesce(found, F.lit(False))


def verdict(sender: Column, return_path: Column, list_id: Column, plain: Column, classified: Column, platforms: list[str] | None = None, promotions: list[str] | None = None) -> Column:
    """Whether mail is a newsletter, by the first rule that decides: promotion domain, no-reply sender, platform domain,
    list mail by the classifier (null: by its length), nothing else."""
    address = F.lower(F.regexp_extract(F.coalesce(sender, F.lit("")), r"<?\s*([^<>\s]+@[^<>\s]+)\s*>?", 1))
    back = F.lower(F.regexp_extract(F.coalesce(return_path, F.lit("")), r"<?\s*([^<>\s]+@[^<>\s]+)\s*>?", 1))
    belongs = lambda names: _ends_with_any(domain_of(address), names) | _ends_with_any(domain_of(back), names)
    long = F.size(F.filter(F.split(F.coalesce(plain, F.lit("")), r"\s+"), lambda w: w != "")) >= LEAST_WORDS
    return (
        F.when(belongs(PROMOTIONS if promotions is None else promotions), False)
        .when(address.startswith("noreply@") | address.startswith("no-reply@"), False)
        .when(belongs(PLATFORMS if platforms is None else platforms), True)
        .when(F.coalesce(list_id, F.lit("")) != "", F.coalesce(classified, long))
        .otherwise(False)
    )


# Examples ------------------------------------------------------------------------------------------


def tidy_label(label: Column) -> Column:
    """KEEP or SKIP in capitals; null for anything else."""
    name = F.upper(F.trim(label))
    return F.when(name.isin(KEEP, SKIP), name)


def merged_examples(bootstrap: DataFrame, feedback: DataFrame) -> DataFrame:
    """Examples by id, feedback over bootstrap, later rows over earlier ones; rows without an id all stay."""
    both = bootstrap.withColumn("_rank", F.lit(0)).unionByName(feedback.withColumn("_rank", F.lit(1)))
    named = both.where("id is not null and id <> ''")
    columns = [c for c in bootstrap.columns if c != "id"]
    last = named.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("_rank", F.coalesce("ts", F.lit(0)), "row_id")).alias("r")).select("id", "r.*")
    return last.select(*bootstrap.columns).unionByName(both.where("id is null or id = ''").select(*bootstrap.columns))


def stratified(examples: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``examples`` with ``held``: about ``n`` rows held out, from each label its share, at least one; chosen by hash.

    Only the first ``n`` ranks of a label are kept, which Spark does before the shuffle.
    """
    keyed = examples.select("row_id", "label", F.md5(F.concat_ws(":", F.col("row_id").cast("string"), F.lit(str(seed)))).alias("h"))
    sizes = examples.groupBy("label").agg(F.count("*").alias("size"))
    total = F.sum("size").over(Window.partitionBy(F.lit(0)))
    quota = sizes.select(F.col("label").alias("l"), F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("size") / total, 0)).alias("quota"))
    ranked = keyed.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "row_id"))).where(F.col("n") <= max(n, 1))
    held = ranked.join(F.broadcast(quota), F.col("label").eqNullSafe(F.col("l"))).where(F.col("n") <= F.col("quota")).select("row_id", F.lit(True).alias("held"))
    return examples.join(held, "row_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))


# The classifier ------------------------------------------------------------------------------------


class Damped(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts c to 1 + ln(c), of sparse vectors; MLlib has no such stage, so this one is Python's, and saved with its pipeline."""

    @keyword_only
    def __init__(self, *, inputCol: str = "counts", outputCol: str = "damped"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        damp = F.udf(lambda v: SparseVector(v.size, v.indices, 1 + np.log(v.values)), VectorUDT())
        return dataset.withColumn(self.getOutputCol(), damp(self.getInputCol()))


def pipeline(vocabulary: int = 20_000, iterations: int = 2000, penalty: float = 1e-3) -> Pipeline:
    """Words and pairs of words, damped counts weighted by inverse document frequency, at unit length, into logistic regression with balanced classes."""
    words = RegexTokenizer(inputCol="folded", outputCol="words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)
    pairs = NGram(n=2, inputCol="words", outputCol="pairs")
    both = SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")
    counts = CountVectorizer(inputCol="terms", outputCol="counts", minDF=2, maxDF=0.95, vocabSize=vocabulary)
    weights = IDF(inputCol="damped", outputCol="tfidf", minDocFreq=2)
    unit = Normalizer(inputCol="tfidf", outputCol="features", p=2.0)
    decide = LogisticRegression(labelCol="y", weightCol="weight", maxIter=iterations, regParam=penalty, standardization=False)
    return Pipeline(stages=[words, pairs, both, counts, Damped(inputCol="counts", outputCol="damped"), weights, unit, decide])


def featured(examples: DataFrame) -> DataFrame:
    """Examples with ``folded``, the text the classifier sees."""
    return examples.withColumn("folded", text.fold(text.newsletter_features(F.col("sender"), F.col("subject"), F.col("body"))))


def train(examples: DataFrame, vocabulary: int = 20_000) -> PipelineModel:
    """Fit on the examples labelled KEEP or SKIP, each class with the same total weight."""
    rows = featured(examples.withColumn("label", tidy_label(F.col("label"))).where("label is not null"))
    rows = rows.withColumn("y", (F.col("label") == KEEP).cast("double"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        raise ValueError("examples of both labels are needed")
    weight = F.when(F.col("y") == 1.0, F.lit(total / (2 * sizes.get(1.0, 1)))).otherwise(F.lit(total / (2 * sizes.get(0.0, 1))))
    return pipeline(vocabulary, penalty=1 / max(total, 1)).fit(rows.withColumn("weight", weight))


def predicted(model: PipelineModel, examples: DataFrame) -> DataFrame:
    """Examples with ``predicted`` and ``p_keep``."""
    scored = model.transform(featured(examples))
    return scored.select(*examples.columns, F.when(F.col("prediction") == 1.0, KEEP).otherwise(SKIP).alias("predicted"), vector_to_array("probability")[1].alias("p_keep"))


def accuracy(rows: DataFrame, label: str = "label", guess: str = "predicted") -> DataFrame:
    """(n, accuracy): NaN without rows."""
    right = F.avg((F.col(label) == F.col(guess)).cast("double"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(right, F.lit(float("nan"))).alias("accuracy"))


def confusion(rows: DataFrame, label: str = "label", guess: str = "predicted") -> DataFrame:
    """(label, n_KEEP, n_SKIP): how often each label is taken for which."""
    return rows.groupBy(label).agg(*[F.count_if(F.col(guess) == g).alias(f"n_{g}") for g in (KEEP, SKIP)])


def quality(rows: DataFrame, label: str = "label", guess: str = "predicted") -> DataFrame:
    """(label, n, precision, recall, f1) of each label that occurs or is guessed; null where it is of nothing."""
    pairs = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("l"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    each = pairs.select("n", F.explode(F.array_distinct(F.array("l", "g"))).alias("label"), "l", "g").where("label is not null")
    hit, said, is_ = (F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in ((F.col("l") == F.col("label")) & (F.col("g") == F.col("label")), F.col("g") == F.col("label"), F.col("l") == F.col("label")))
    counted = each.groupBy("label").agg(hit.alias("hit"), said.alias("said"), is_.alias("n"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counted.select("label", "n", share("hit", "said").alias("precision"), share("hit", "n").alias("recall"), F.when(F.col("said") + F.col("n") > 0, 2 * F.col("hit") / (F.col("said") + F.col("n"))).alias("f1"))


def difference(rows: DataFrame, label: str, old: str, new: str) -> DataFrame:
    """(good, bad, mixed, net): rows on which two models differ: newly right, newly wrong, wrong otherwise."""
    differ, right_old, right_new = F.col(old) != F.col(new), F.col(old) == F.col(label), F.col(new) == F.col(label)
    good, bad = F.count_if(differ & right_new & ~right_old), F.count_if(differ & right_old & ~right_new)
    return rows.agg(good.alias("good"), bad.alias("bad"), F.count_if(differ & ~right_old & ~right_new).alias("mixed"), (good - bad).alias("net"))


@dataclass(frozen=True)
class Retrained:
    """A candidate, how it and the current model did on the holdout, and whether it took over."""

    model: PipelineModel
    accuracy: float
    current_accuracy: float
    promoted: bool


def _exists(spark, path: str) -> bool:
    target, files = file_system(spark, path)
    return bool(files.exists(target))


def _moved(spark, old: str, new: str) -> None:
    """Rename a folder over another."""
    source, files = file_system(spark, old)
    target, _ = file_system(spark, new)
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"{old} could not become {new}")


def retrain(examples: DataFrame, holdout: DataFrame, path: str, force: bool = False) -> Retrained:
    """Train, compare on the holdout, and save to ``path`` only a model that is no worse (or if forced).

    A missing model is no rival; one that cannot be read is an error, and nothing is replaced. The replaced
    model is kept beside the new one, as ``path`` with ``.bak``.
    """
    spark = examples.sparkSession
    held = holdout.withColumn("label", tidy_label(F.col("label"))).where("label is not null")
    score = lambda m: accuracy(predicted(m, held)).first()["accuracy"]
    known = _exists(spark, path)
    old = score(PipelineModel.load(path)) if known else float("nan")
    candidate = train(examples)
    new = score(candidate)
    promoted = force or not known or new >= old or old != old
    if promoted:
        candidate.write().overwrite().save(f"{path}.new")
        if known:
            _moved(spark, path, f"{path}.bak")
        _moved(spark, f"{path}.new", path)
    return Retrained(candidate, new, old, promoted)


def split_report(examples: DataFrame, share: float = 0.2, seed: int = 42, vocabulary: int = 20_000) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """(quality, confusion, model): how a model does on a stratified ``share`` that it did not see, and the model fitted to all examples."""
    rows = examples.withColumn("label", tidy_label(F.col("label"))).where("label is not null")
    split = staged(stratified(rows, max(1, round(share * rows.count())), seed), "split")
    judged = staged(predicted(train(split.where("not held").drop("held"), vocabulary), split.where("held").drop("held")), "judged")
    return quality(judged), confusion(judged), train(rows, vocabulary)


def freeze_holdout(examples: DataFrame, path: str, n: int = 100, seed: int = 42) -> DataFrame:
    """Write a stratified holdout of about ``n`` rows and the other rows as JSON lines below ``path``; once: an existing holdout is an error."""
    split = staged(stratified(examples, n, seed), "frozen")
    split.where("held").drop("held").write.mode("errorifexists").json(f"{path}/holdout")
    split.where("not held").drop("held").write.mode("errorifexists").json(f"{path}/train")
    return split


def resolved_model(spark, *paths: str | None) -> PipelineModel | None:
    """The model of the first path that has one, a user's before a bundled one; none if no path has."""
    for path in paths:
        if path and _exists(spark, path):
            return PipelineModel.load(path)
    return None


def labelled(mail: DataFrame, labeller, column: str = "body") -> DataFrame:
    """``mail`` with ``label``, ``raw`` and ``label_error`` from an object whose ``label`` takes (sender, subject, text) and answers.

    An answer other than KEEP or SKIP, or a failure, leaves the label null, with what was said in ``raw``.
    """
    rows = mail.drop("label", "raw", "label_error")
    names, at = rows.columns, {c: rows.columns.index(c) for c in ("sender", "subject", column)}

    def run(batches):
        for batch in batches:
            said, errors = [], []
            for args in zip(*(batch.column(at[c]).to_pylist() for c in ("sender", "subject", column))):
                try:
                    said.append(labeller.label(*[a or "" for a in args]))
                    errors.append(None)
                except Exception as error:  # a row without a label, not a failed task
                    said.append(None)
                    errors.append(str(error)[:2000])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(errors, pa.string())], [*names, "raw", "label_error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, raw string, label_error string").withColumn("label", tidy_label(F.col("raw")))

"""Transaction categories: keyword rules first, a text model for the rest.

The rules are one generated CASE expression (``tally.functions.text``).
The text model is a pyspark.ml pipeline trained on labelled rows; scoring
is a projection, so categorizing a ledger is a single pass.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, IndexToString, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.errors import ModelNotFoundError, ValidationError
from tally.functions.constraints import label_constraints
from tally.functions.text import NORM_COL, rule_category, rule_category_col, with_normalized
from tally.schema import FALLBACK_CONFIDENCE, RULE_CONFIDENCE
from tally.session import checkpoint_root
from tally.sources import files
from tally.sources.ledger import staged

MODEL_INPUT = "_model_text"
HASH_FEATURES = 1 << 16


def with_rule_category(df: DataFrame, out: str = "rule_category") -> DataFrame:
    """Rule category (null when no rule applies)."""
    return with_normalized(df).withColumn(out, rule_category_col()).drop(NORM_COL)


def _given(c: str = "category"):
    """A provided category counts when it is non-empty."""
    return F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(c))


def resolve_category(df: DataFrame) -> DataFrame:
    """I4: the given category if non-empty, else the rule, else Miscellaneous."""
    return (with_normalized(df)
            .withColumn("category", F.coalesce(_given(), rule_category_col(), F.lit("Miscellaneous")))
            .drop(NORM_COL))


def categorize_scored(df: DataFrame) -> DataFrame:
    """Rule category or Miscellaneous, confidence 0.85 / 0.6, method."""
    cat = F.coalesce(rule_category_col(), F.lit("Miscellaneous"))
    return (with_normalized(df).withColumn("category", cat).drop(NORM_COL)
            .withColumn("confidence", F.when(F.col("category") == "Miscellaneous", F.lit(FALLBACK_CONFIDENCE))
                        .otherwise(F.lit(RULE_CONFIDENCE)))
            .withColumn("method", F.lit("rule_based")))


def fill_categories(ledger: DataFrame) -> DataFrame:
    """Rows with a null/empty category get the I5 category; others keep
    theirs.  Adds ``was_filled`` for the report."""
    scored = F.coalesce(rule_category_col(), F.lit("Miscellaneous"))
    filled = _given().isNull()
    return (with_normalized(ledger).withColumn("was_filled", filled)
            .withColumn("category", F.when(filled, scored).otherwise(F.col("category"))).drop(NORM_COL))


def fill_report(filled: DataFrame) -> DataFrame:
    """I6 counts per account: categorized now / already categorized."""
    return filled.groupBy("account_id").agg(
        F.sum(F.col("was_filled").cast("bigint")).alias("categorized"),
        F.sum((~F.col("was_filled")).cast("bigint")).alias("already_categorized"))


# --------------------------------------------------------------------------
# Text model
# --------------------------------------------------------------------------

def check_labels(labelled: DataFrame, require_known: bool = False) -> DataFrame:
    """Training rows: description and category present (nulls dropped);
    with ``require_known`` also B9 (1-500 chars, one of the eight)."""
    missing = {"description", "category"} - set(labelled.columns)
    if missing:
        raise ValidationError("A labelled table needs the columns description and category")
    rows = labelled.where(F.col("description").isNotNull() & F.col("category").isNotNull())
    if require_known:
        rows = rows.where(label_constraints() == "")
    return rows.select(F.col("description").cast("string").alias("description"),
                       F.col("category").cast("string").alias("category"))


def _fit(labelled: DataFrame, counter, learn) -> PipelineModel:
    """Tokens counted by ``counter``, then the fitted stages that ``learn``
    gives for the counts and a number of labels.  The counts are staged: every
    pass of the learning reads them, none cuts the texts again."""
    rows = check_labels(labelled).withColumn(MODEL_INPUT, F.col("description"))
    idx_model = StringIndexer(inputCol="category", outputCol="_label", handleInvalid="skip").fit(rows)
    tokens = RegexTokenizer(inputCol=MODEL_INPUT, outputCol="_tokens", pattern=r"\W+", minTokenLength=1)
    counting = Pipeline(stages=[tokens, counter]).fit(rows)
    counts = staged(counting.transform(idx_model.transform(rows)).select("_label", counter.getOutputCol()), "counts")
    # The scoring model has no label stage: it never reads (or filters on)
    # an existing category column.
    return PipelineModel(stages=[*counting.stages, *learn(counts, len(idx_model.labels)),
                                 IndexToString(inputCol="_pred", outputCol="model_category",
                                               labels=idx_model.labels)])


def _regression(max_iter: int, reg: float) -> LogisticRegression:
    return LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_pred", probabilityCol="_prob",
                              rawPredictionCol="_raw", family="multinomial", maxIter=max_iter, regParam=reg)


def train_text_model(labelled: DataFrame, max_iter: int = 50, reg: float = 0.01) -> PipelineModel:
    """Multiclass text classifier description -> category.

    Tokenize -> hashed term counts -> IDF -> multinomial logistic regression
    -> label back to string.  Training is distributed (tree-aggregated
    gradients); no data is collected.
    """
    learn = Pipeline(stages=[IDF(inputCol="_tf", outputCol="_features"), _regression(max_iter, reg)])
    return _fit(labelled, HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=HASH_FEATURES),
                lambda counts, labels: learn.fit(counts).stages)


def train_tree_model(labelled: DataFrame, terms: int = 512, rounds: int = 20, depth: int = 5, step: float = 0.3,
                     seed: int = 7) -> PipelineModel:
    """I2 by boosted trees: which of the ``terms`` commonest words a text has
    -> per category, ``rounds`` trees against the rest -> a regression over
    the margins picks the category.

    Trees see words together (a word that means one thing beside a second word
    and another without it), which the linear model cannot.  Split statistics
    are aggregated per partition; the driver holds the vocabulary and the
    trees, both bounded by the parameters.  Scoring stays in the JVM.  Boosting
    cuts its lineage in the checkpoint folder.
    """
    checkpoint_root(labelled.sparkSession)

    def learn(counts: DataFrame, labels: int) -> list:
        boosters = [GBTClassifier(featuresCol="_words", labelCol=f"_is{i}", predictionCol=f"_pred{i}", maxIter=rounds,
                                  maxDepth=depth, stepSize=step, seed=seed, checkpointInterval=10)
                    .setProbabilityCol(f"_prob{i}").setRawPredictionCol(f"_margin{i}")
                    .fit(counts.withColumn(f"_is{i}", (F.col("_label") == i).cast("double"))) for i in range(labels)]
        margins = VectorAssembler(inputCols=[f"_margin{i}" for i in range(labels)], outputCol="_features")
        scored = staged(PipelineModel(stages=[*boosters, margins]).transform(counts).select("_label", "_features"), "margins")
        return [*boosters, margins, _regression(max_iter=50, reg=0.001).fit(scored)]

    return _fit(labelled, CountVectorizer(inputCol="_tokens", outputCol="_words", vocabSize=terms, binary=True), learn)


def model_classes(model: PipelineModel) -> list[str]:
    """Sorted class labels of a trained model (model metadata, tiny)."""
    return sorted(model.stages[-1].getLabels())


def categorize(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Rules first; the model fills every row the rules leave null.

    One pass: rows decided by a rule feed the model an empty text (nothing
    to tokenize), so only the undecided rows cost scoring work.  Existing
    categories are overwritten, and every row ends non-null.
    """
    scored_in = (with_normalized(df).withColumn("_rule", rule_category_col()).drop(NORM_COL)
                 .withColumn(MODEL_INPUT, F.when(F.col("_rule").isNull(),
                                                 F.coalesce(F.col("description").cast("string"), F.lit("")))
                             .otherwise(F.lit(""))))
    out = model.transform(scored_in)
    return (out.withColumn("category", F.coalesce(F.col("_rule"), F.col("model_category")))
            .withColumn("category_source", F.when(F.col("_rule").isNotNull(), "rule").otherwise("model"))
            .select(*df.columns, *([] if "category" in df.columns else ["category"]), "category_source"))


def load_model(path: str) -> PipelineModel:
    """Never trains implicitly; a missing model raises ModelNotFoundError.
    One that is there but cannot be read raises what its reader does."""
    if not files.exists(SparkSession.active(), f"{path}/metadata"):
        raise ModelNotFoundError(f"No categorizer at {path}")
    return PipelineModel.load(path)


def retrain_text_model(labelled: DataFrame, path: str, train=train_text_model, **kw) -> PipelineModel:
    """I8: explicit retrain on checked labels (``train``: the linear model or
    ``train_tree_model``), then save (overwrite)."""
    model = train(check_labels(labelled, require_known=True), **kw)
    model.write().overwrite().save(path)
    return model


def record_text_model(model: PipelineModel, path: str, version: int) -> None:
    """Save a version beside the earlier ones; it counts once its mark is set."""
    spark, place = SparkSession.active(), f"{path}/version={version}"
    files.remove(spark, f"{place}/_done")
    model.write().overwrite().save(f"{place}/model")
    files.touch(spark, f"{place}/_done")


def text_model_as_of(path: str, version: int | None = None) -> PipelineModel:
    """I7 for versions: the last complete one up to ``version`` (None: of all)."""
    spark = SparkSession.active()
    held = [int(n.split("=", 1)[1]) for n in files.children(spark, path) if n.startswith("version=")]
    for v in sorted((v for v in held if version is None or v <= version), reverse=True):
        if files.exists(spark, f"{path}/version={v}/_done"):
            return load_model(f"{path}/version={v}/model")
    raise ModelNotFoundError(f"No categorizer at {path}" + ("" if version is None else f" up to {version}"))

"""Training cuts the texts once: every pass reads the staged counts."""

from tally.operators import categorize as C


def test_counts_are_staged_for_both_models(spark, monkeypatch):
    texts = [("red ring", "a"), ("red bolt", "b"), ("blue ring", "b"), ("blue bolt", "a"), ("old plate", "c"), ("", "c")] * 20
    rows = spark.createDataFrame([*texts, (None, "a"), ("x", None)], "description string, category string")
    seen, real = [], C.staged

    def spy(df, name):
        seen.append((name, df.columns))
        return real(df, name)

    monkeypatch.setattr(C, "staged", spy)
    for train, column, learned in ((C.train_text_model, "_tf", 5), (C.train_tree_model, "_words", 8)):
        seen.clear()
        model = train(rows)
        assert seen[0] == ("counts", ["_label", column])
        assert len(model.stages) == learned and C.model_classes(model) == ["a", "b", "c"]
        got = model.transform(rows.withColumn(C.MODEL_INPUT, rows.description).where("description is not null"))
        assert got.where("model_category is null").isEmpty()
    assert got.where("category is not null and model_category != category").isEmpty()  # trees tell the words apart together

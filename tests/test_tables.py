"""Transforms, counts, scores, files, and the SQL counterparts on the smallest tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import evenhand.plans.runtime as runtime
from evenhand.operators import counts, fairness, models, perturb, ranks, scores, splits, transform, trees
from evenhand.plans.calibrate import calibrate, cross_device
from evenhand.plans.dataset import ClientDataset, DatasetOptions
from evenhand.plans.evaluate import evaluate_fairness
from evenhand.sources.client_files import load_client_csvs, load_clients, save_clients
from evenhand.sources.reports import config_json, read_distribution
from evenhand.sources.tables import default_partitions, read_clients
from evenhand.spec import FairSpec, Modification, TaskSpec, task
from tests.check_oracles import database, differs

SF = "/root/testdata/sf0.001"
SPEC = FairSpec(("g",), "y", ("client",), ("id",))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differs(got, database(SF).execute(entry.oracle_sql()[name]).df()) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_remap_keeps_other_numbers_as_they_are(table):
    from decimal import Decimal

    df = table("a long, b decimal(20,2)", (2**53 + 1, Decimal("12345678901234567.89")), (3, Decimal("1.00")))
    rows = transform.remap(df, {"a": {3: 4}, "b": {1: 2}}).collect()
    assert [tuple(r) for r in rows] == [(2**53 + 1, Decimal("12345678901234567.89")), (4, Decimal("2.00"))]


def test_null_clients_and_unscored_rows(table):
    spec = FairSpec(("g",), "y", ("client",), ("id",), "p")
    df = table("client string, id long, g string, y boolean, p boolean", *[
        (c, i, "ab"[i % 2], i % 3 == 0, None if i > 7 else i % 2 == 0) for c in (None, "x") for i in range(10)])
    assert {r["client"] for r in fairness.fairness(df, spec, "DP", "attribute-value").collect()} == {None, "x"}
    assert {r["client"] for r in scores.score_table(df, spec).collect()} == {None, "x"}
    assert {(r["rows"], r["unscored"]) for r in scores.unscored(df, spec).collect()} == {(10, 2)}


def test_labels_that_are_no_codes_are_an_error(table):
    rows = table("dataset string, model string, DP_RACE double, value_DP_RACE string",
                 ("a", "LogisticRegression", 0.1, "WHITE_BLACK"), ("a", "XGBoost", 0.1, "WHITE_BLACK"))
    with pytest.raises(ValueError, match="numeric codes"):
        scores.value_vote(rows)


def test_no_folder_of_our_own_on_a_cluster():
    class Far:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Far)


def test_a_fit_that_does_not_converge_is_an_error(spark):
    with pytest.raises(ArithmeticError, match="steps"):
        models.fit_logistic(microdata(spark), "PINCP", ["AGEP"], max_iter=1)


def test_estimators_of_spark_are_models_too(spark):
    from pyspark.ml.classification import LogisticRegression

    df = splits.holdout(microdata(spark, 1000), CENSUS)
    table = models.evaluate_models(df, CENSUS, ["AGEP", "WKHP"], ~F.col("is_test"), F.col("is_test"),
                                   models={"Pooled": models.pipeline_model(LogisticRegression())}).collect()
    assert {r["model"] for r in table} == {"Pooled"} and len(table) == 2


def test_remap_is_not_chained(table):
    df = table("v double", (3.0,), (5.0,), (8.0,), (1.0,), (None,))
    assert [r["v"] for r in transform.remap(df, {"v": {3: 4, 5: 4, 8: 5}}).collect()] == [4.0, 4.0, 5.0, 1.0, None]


def test_scaling_and_encoding(table):
    df = table("client string, v double, k double", ("a", 1.0, 1.0), ("a", 3.0, 2.0), ("b", 5.0, 2.0))
    assert [r["v"] for r in transform.minmax(df, ["v"]).orderBy("v").collect()] == [0.0, 0.5, 1.0]
    by = {(r["client"], r["v"]) for r in transform.minmax(df, ["v"], by=["client"]).collect()}
    assert by == {("a", 0.0), ("a", 1.0), ("b", None)}
    fitted = transform.minmax(df, ["v"], fit=F.col("client") == "a").orderBy("v").collect()
    assert [r["v"] for r in fitted] == [0.0, 1.0, 2.0]
    hot = transform.one_hot(df, ["k"])
    assert hot.columns == ["client", "v", "k_1.0", "k_2.0"] and [tuple(r)[2:] for r in hot.collect()] == [
        (1, 0), (0, 1), (0, 1)]
    with pytest.raises(ValueError, match="categorical"):
        transform.categories(df, ["v"], most=2)


def test_task_checks(table):
    with pytest.raises(ValueError, match="unknown task"):
        task("housing")
    assert task("employment", ("AGEP",)).label == "ESR" and len(default_partitions()) == 51
    df = table("client string, row_id long, a double, y double", ("c", 1, None, 1.0), ("c", 2, 2.0, 0.0))
    made = transform.apply_task(df, TaskSpec("t", ("a",), "y", F.col("y") > 0, fill=-1.0)).collect()
    assert [(r["a"], r["y"]) for r in made] == [(-1.0, True), (2.0, False)]


def test_shares_round_half_to_even_and_leave_nulls_out(table):
    rows = [("c", i, "x" if i == 0 else "z", True) for i in range(16)] + [("c", 99, None, True)]
    df = table("client string, id long, g string, y boolean", *rows).withColumn("partition_id", F.lit(0))
    shares = {(r["level"], r["value"]): r["share"] for r in counts.proportions(df, SPEC).collect()}
    assert shares["overall", "x"] == shares["client", "x"] == shares["partition", "x"] == 0.062
    with_nulls = {(r["level"], r["value"]): r["share"]
                  for r in counts.proportions(df, SPEC, overall_nulls=True).collect()}
    assert with_nulls["overall", None] == 0.059 and with_nulls["client", "x"] == 0.062


def test_votes(table):
    """The published rows of two clients, and one client whose models disagree."""
    df = table("model string, dataset string, DP_SEX double, DP_RACE double, value_DP_RACE string",
               ("LogisticRegression", "AL", 0.08685, 0.11071, "1.0_4.0"),
               ("XGBoost", "AL", 0.14923, 0.15088, "1.0_4.0"),
               ("LogisticRegression", "AK", 0.01640, 0.25973, "1.0_4.0"),
               ("XGBoost", "AK", 0.06455, 0.36345, "1.0_4.0"),
               ("LogisticRegression", "ZZ", 0.2, 0.1, "3.0_12.0"), ("XGBoost", "ZZ", 0.1, 0.2, "3.0_1.0"),
               ("Other", "AL", 9.0, 0.0, "1.0_2.0"))
    votes = {r["dataset"]: (r["vote"], r["min_gap"]) for r in scores.attribute_vote(df).collect()}
    assert votes == {"AL": ("RAC1P", 0.11071), "AK": ("RAC1P", 0.25973), "ZZ": (None, None)}
    codes = {r["dataset"]: (r["vote"], r["first_code"], r["last_code"]) for r in scores.value_vote(df).collect()}
    assert codes == {"AL": (4, 1, 4), "AK": (4, 1, 4), "ZZ": (None, 3, 12)}
    plan = {r["client"]: (r["column"], r["value"]) for r in scores.plan_next(df, 0.1).collect()}
    assert plan == {"ZZ": ("SEX", "2")}
    plan = {r["client"]: (r["column"], r["value"]) for r in scores.plan_next(df, 0.1, "value", threshold=0.2).collect()}
    assert plan == {"AL": ("RAC1P", "1"), "ZZ": ("RAC1P", "12")}
    assert [r["dataset"] for r in scores.select_clients(df).collect()] == []
    chosen = {r["dataset"] for r in scores.select_clients(df, "value").collect()}
    assert chosen == {"AL", "AK"}
    found = scores.unfairness_distribution(df).first()
    assert (found["attribute"], found["number"], found["states"]) == ("RAC1P", 2, ["AK", "AL"])


def test_combining(table):
    one = table("client string, v double", ("a", 0.1), ("b", 0.4))
    two = table("client string, v double", ("a", 0.3), ("c", 0.9))
    compared = scores.compare_clients(one, two, "client", "v")
    assert [tuple(r) for r in compared.collect()] == [("a", 0.1, 0.3)]
    span = scores.comparison_range(compared).first()
    assert (round(span["low"], 9), round(span["high"], 9)) == (0.05, 0.35)
    with pytest.raises(ValueError, match="not unique"):
        scores.compare_clients(one.union(one), two, "client", "v")
    tagged = scores.union_tagged([table("a int, b int", (1, 2)), table("a int, c int", (3, 4))], ["x", "y"])
    assert sorted(map(tuple, tagged.select("state", "a", "b", "c").collect())) == [("x", 1, 2, None), ("y", 3, None, 4)]
    with pytest.raises(ValueError, match="name"):
        scores.union_tagged([one], [])
    mean = scores.weighted_metric(table("n long, accuracy double", (10, 0.5), (30, 0.9))).first()["accuracy"]
    assert mean == pytest.approx(0.8)


def test_client_files(spark, table, tmp_path):
    df = table("split string, partition_id int, x double, y boolean", ("AK_train", 0, 1.5, True),
               ("AK_train", 1, 2.5, False), ("CT_val", 0, 3.5, True))
    for fmt in ("csv", "parquet"):
        save_clients(df, f"{tmp_path}/{fmt}", fmt)
        back = load_clients(spark, f"{tmp_path}/{fmt}", fmt, df.schema if fmt == "csv" else None)
        assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "AK_0.csv").write_text("x,y\n1.0,true\n")
    (flat / "CT_1.csv").write_text("x,y\n2.0,false\n")
    (flat / "model_perf_DP.csv").write_text("model,accuracy\nm,0.5\n")
    read = load_client_csvs(spark, str(flat), df.select("x", "y").schema)
    assert sorted(map(tuple, read.collect())) == [("AK", 1.0, True), ("CT", 2.0, False)]


def test_published_distribution_format(spark, tmp_path):
    (tmp_path / "a.csv").write_text("number,attribute,states\n2,SEX,['AL', 'WA_3']\n0,RAC1P,[]\n")
    (tmp_path / "v.csv").write_text("number,attribute,value,value_int,states\n1,RAC1P,White,1,\"['AK']\"\n")
    rows = [tuple(r) for r in read_distribution(spark, str(tmp_path / "a.csv")).collect()]
    assert rows == [(2, "SEX", ["AL", "WA_3"]), (0, "RAC1P", [])]
    assert read_distribution(spark, str(tmp_path / "v.csv"), "value").first()["value_int"] == 1


def test_reading_prunes_partitions(spark, table, tmp_path):
    df = table("client string, year int, x double", ("AK", 2018, 1.0), ("CT", 2018, 2.0), ("AK", 2019, 3.0))
    df.write.partitionBy("client", "year").parquet(f"{tmp_path}/t")
    read = read_clients(spark, f"{tmp_path}/t", ["AK"], 2018)
    assert [r["x"] for r in read.collect()] == [1.0] and len(read.inputFiles()) >= 1
    assert read_clients(spark, f"{tmp_path}/t").count() == 3


def microdata(spark, n=4000):
    """Two clients; the label follows the features, and SEX 2 is positive less often."""
    r = lambda seed: F.rand(seed)
    df = spark.range(n).select(
        F.when(F.col("id") % 4 < 3, "AK").otherwise("CT").alias("client"), F.col("id").alias("row_id"),
        F.floor(r(1) * 10).alias("AGEP"), F.floor(r(2) * 5).alias("WKHP"),
        (F.floor(r(3) * 2) + 1).cast("double").alias("SEX"), (F.floor(r(4) * 3) + 1).cast("double").alias("RAC1P"),
        (F.floor(r(5) * 2) + 1).cast("double").alias("MAR"), r(6).alias("u"))
    score = F.col("AGEP") * 0.3 + F.col("WKHP") * 0.4 - F.col("SEX") * 0.6 - 1.2
    return df.withColumn("PINCP", F.col("u") < 1 / (1 + F.exp(-score))).drop("u")


CENSUS = FairSpec(("SEX", "RAC1P", "MAR"), "PINCP", ("client",), ("row_id",))


def test_client_models_equal_newton_in_numpy(spark):
    df = microdata(spark).cache()
    for precount in (False, True):
        found = {r["client"]: r["w"] for r in models.fit_logistic(
            df, "PINCP", ["AGEP", "WKHP"], precount=precount).collect()}
        for client in ("AK", "CT"):
            pdf = df.where(F.col("client") == client).toPandas()
            x = np.column_stack([pdf["AGEP"], pdf["WKHP"], np.ones(len(pdf))]).astype(float)
            y, w, ridge = pdf["PINCP"].to_numpy(float), np.zeros(3), np.diag([1.0, 1.0, 0.0])
            for _ in range(30):
                p = 1 / (1 + np.exp(-x @ w))
                w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
            assert np.allclose(found[client], w, atol=1e-4)


def test_dataset_preparation_and_audit(spark, tmp_path):
    options = DatasetOptions(
        TaskSpec("income", ("AGEP", "WKHP", "SEX", "RAC1P", "MAR"), "PINCP"), CENSUS, partitions={"AK": 2},
        mapping={"RAC1P": {3: 2}}, modifications=[Modification("AK", 0, "SEX", 2, 0.5, 0.0)], setting="cross-silo")
    data = ClientDataset(microdata(spark), options)
    names = {(r["split"], r["partition_id"]) for r in data.table.select("split", "partition_id").distinct().collect()}
    assert names == {(f"AK_{f}", i) for f in splits.FOLDS for i in (0, 1)} | {(f"CT_{f}", 0) for f in splits.FOLDS}
    counted, gaps = data.evaluate()
    assert {r["value"] for r in counted.where("attribute = 'RAC1P'").collect()} == {"1.0", "2.0"}
    assert gaps.count() == 9 * 3
    with pytest.warns(UserWarning, match="sensitive"):
        data.save(str(tmp_path / "out"))
    back = load_clients(spark, str(tmp_path / "out"), "csv")
    assert back.count() == data.table.count() == sum(
        data.load_split(s).count() for s, i in names if i == 0)
    assert data.load_partition("AK_train", 1).count() > 0
    assert json.loads(data.to_json())["spec"]["label"] == "PINCP"
    counted, gaps = evaluate_fairness(data.table.drop("split"), CENSUS, "EO", "value", model="LogisticRegression",
                                      path=str(tmp_path / "report"))
    assert gaps.count() == 3 * 3
    assert data.proportions().where("level = 'overall'").count() == 6
    with pytest.raises(ValueError, match="unknown setting"):
        DatasetOptions(options.task, CENSUS, setting="other")


def test_calibration_and_chunks_of_clients(spark):
    df = microdata(spark)
    fast = {"LogisticRegression": {"precount": True}}
    found, log, spread, changed = calibrate(df, CENSUS, ["AGEP", "WKHP"], (0.4,), models=("LogisticRegression",), options=fast)
    assert {r["dataset"] for r in found.collect()} == {"AK", "CT"}
    assert set(log.columns) == {"state", "drop_rate", "attribute", "value", "applied"} and "states" in spread.columns
    last = {r["state"]: r for r in log.where("applied").collect()}
    for client in ("AK", "CT"):
        before, after = (d.where(F.col("client") == client) for d in (df, changed))
        entry_ = last.get(client)
        hit = F.col("PINCP") & (F.col(entry_["attribute"]) == entry_["value"]) if entry_ else F.lit(False)
        assert after.count() == before.count() - int(before.where(hit).count() * 0.4)
    rows, chosen = cross_device(df, CENSUS, 2, ["row_id"], ["AGEP", "WKHP"], level="value",
                                models=("LogisticRegression",), options=fast)
    names = {r["dataset"] for r in chosen.collect()}
    assert names <= {"AK_0", "AK_1", "CT_0", "CT_1"}
    assert {r["client"] for r in rows.select("client").distinct().collect()} == names


def grow(bins, g, h, rows, depth, node, leaves):
    """A node's leaf value and best split by trying all, as the boosting defines them."""
    total, weight = g[rows].sum(), h[rows].sum()
    leaves.setdefault(node, -0.3 * total / (weight + 1))
    if depth == 0:
        return
    best = None
    for j in range(bins.shape[1]):
        for b in np.unique(bins[rows, j])[:-1]:
            left, right = rows & (bins[:, j] <= b), rows & (bins[:, j] > b)
            sums = [(g[part].sum(), h[part].sum()) for part in (left, right)]
            if min(w for _, w in sums) < 1:
                continue
            gain = sum(s * s / (w + 1) for s, w in sums) - total * total / (weight + 1)
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = (gain, left, right)
    if best:
        grow(bins, g, h, best[1], depth - 1, 2 * node, leaves)
        grow(bins, g, h, best[2], depth - 1, 2 * node + 1, leaves)


@pytest.mark.parametrize("local", [trees.LOCAL_VALUES, 0])
def test_client_trees_equal_trying_all_splits(spark, local):
    df = microdata(spark).cache()
    forest = trees.fit_trees(df, "PINCP", ["AGEP", "WKHP"], rounds=2, depth=2, bins=32, local=local)
    grown = {r["client"]: r for r in forest.trees.collect()}
    for client, row in grown.items():
        pdf = df.where(F.col("client") == client).toPandas()
        y = pdf["PINCP"].to_numpy(float)
        bins = np.stack([(pdf[c].to_numpy(float)[:, None] > np.array(e)).sum(1)
                         for c, e in zip(["AGEP", "WKHP"], row["edges"])], 1)
        assert row["base"] == pytest.approx(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        p = 1 / (1 + np.exp(-np.full(len(y), row["base"])))
        leaves = {}
        grow(bins, p - y, p * (1 - p), np.ones(len(y), bool), 2, 1, leaves)
        tree = row["trees"][0]
        assert {n: v for n, v in enumerate(tree["value"]) if n in leaves} == pytest.approx(leaves, abs=1e-9)
        assert all(v == 0 for n, v in enumerate(tree["value"]) if n not in leaves)
    scored = trees.predict_trees(df, forest)
    assert scored.where("prediction = PINCP").count() > 0.6 * df.count()
    unseen = trees.predict_trees(df.withColumn("AGEP", F.lit(None).cast("long")), forest)
    assert unseen.where("prediction is null").count() == 0


def test_trees_split_between_edges_of_the_pooled_rows(spark):
    """A client whose values lie close together is cut by its own quantiles; both ways of growing agree."""
    rows = [("wide", float(i), i % 3 == 0) for i in range(400)] + [("narrow", 200 + i / 1000, i >= 50) for i in range(100)]
    rows += [("missing", None if i % 2 else 1.0, bool(i % 2)) for i in range(40)] + [(None, float(i), i > 5) for i in range(30)]
    df = spark.createDataFrame(rows, "client string, x double, label boolean")
    found = []
    for local in (trees.LOCAL_VALUES, 300, 0):
        forest = trees.fit_trees(df, "label", ["x"], rounds=3, depth=3, bins=16, local=local)
        scored = trees.predict_trees(df, forest)
        assert scored.where("client = 'narrow' and prediction <> label").count() == 0
        assert scored.where("client is null and prediction <> label").count() <= 3
        found.append(sorted([(r["client"], r["x"], r["prediction"]) for r in scored.collect()], key=repr))
    assert found[0] == found[1] == found[2]


def test_large_clients_with_few_bins_are_grown_in_one_task(spark, monkeypatch):
    """Rows beyond the limit are binned first; with the same models, and predicted in shares of a client."""
    rows = [(c, i * 0.37 % 50, i % 7, (i * i) % 11 < 4 + i % 7) for c in ("a", "b") for i in range(900)]
    df = spark.createDataFrame(rows, "client string, x double, z int, label boolean")
    whole = trees.fit_trees(df, "label", ["x", "z"], rounds=3, depth=3, bins=8)

    def apart(*args):
        raise AssertionError("8 by 7 bins of a client fit in one task")

    monkeypatch.setattr(trees, "_grow_large", apart)
    binned = trees.fit_trees(df, "label", ["x", "z"], rounds=3, depth=3, bins=8, local=1000)
    one, two = ({r["client"]: r for r in f.trees.collect()} for f in (whole, binned))
    for client in ("a", "b"):
        assert one[client]["edges"] == two[client]["edges"] and one[client]["base"] == pytest.approx(two[client]["base"])
        assert [t["feature"] for t in one[client]["trees"]] == [t["feature"] for t in two[client]["trees"]]
    found = []
    for share in (trees.SHARE, 100):
        monkeypatch.setattr(trees, "SHARE", share)
        found.append(sorted(map(tuple, trees.predict_trees(df, whole).collect())))
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_many_features_and_both_ways_of_logistic_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 300))
    weights = rng.normal(size=300) * (np.arange(300) < 10)
    y = x @ weights + rng.logistic(size=900) > 0
    rows = [(int(i % 3), bool(y[i]), *map(float, x[i])) for i in range(900)]
    names = [f"f{j}" for j in range(300)]
    df = spark.createDataFrame(rows, "client int, label boolean, " + ", ".join(f"{c} double" for c in names))
    for features in (names[:4], names):
        one, two = ({r["client"]: r["w"] for r in models.fit_logistic(df, "label", features, local=local).collect()} for local in (trees.LOCAL_VALUES, 0))
        assert all(one[c] == pytest.approx(two[c], rel=1e-4, abs=1e-4) for c in range(3)) and len(one) == 3


def test_model_grid(spark):
    df = splits.holdout(microdata(spark, 1000), CENSUS)
    table = models.evaluate_models(
        df, CENSUS, ["AGEP", "WKHP"], ~F.col("is_test"), F.col("is_test"),
        options={"LogisticRegression": {"precount": True}, "XGBoost": {"rounds": 1, "depth": 1}}).collect()
    assert len(table) == 4 and {r["model"] for r in table} == {"LogisticRegression", "XGBoost"}
    with pytest.raises(ValueError, match="model"):
        models.score_models(df, CENSUS, ["AGEP"], F.lit(True), F.lit(True), ("Other",))


def test_config_json():
    import datetime

    made = json.loads(config_json({"spec": SPEC, "day": datetime.date(2018, 1, 2)}))
    assert made["day"] == "2018-01-02" and made["spec"]["client"] == ["client"]


def test_every_rank_is_that_of_a_window(spark, monkeypatch):
    from pyspark.sql import Window

    from evenhand.functions import order_key

    monkeypatch.setattr(ranks, "RANKED_ROWS", 50)
    rows = [(c, i, None if i % 5 == 4 else i % 3, i % 2 == 0) for c, n in (("a", 700), ("b", 40), (None, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "client string, row_id long, g int, y boolean")
    made = ranks.every_rank(df, ["client"], ["row_id"], {"one": ["g"], "two": ["g", "y"], "all": []})
    order = [order_key(["row_id"], 42), "row_id"]
    wanted = made.withColumns({f"w_{n}": F.row_number().over(Window.partitionBy("client", *c).orderBy(*order)) for n, c in (
        ("one", ["g"]), ("two", ["g", "y"]), ("all", []))})
    assert made.count() == len(rows) and wanted.where("one <> w_one or two <> w_two or all <> w_all").count() == 0


@pytest.mark.parametrize("level", ["attribute", "value"])
def test_calibration_rounds_equal_drawing_and_holding_out_anew(spark, monkeypatch, level):
    """Each round's held-out rows are those of the table changed by its plan; and no round draws on all rows again."""
    monkeypatch.setattr(ranks, "RANKED_ROWS", 300)
    df = microdata(spark, 3000).cache()
    plans, seen = [], []

    def noted(*args, **named):
        plans.append(scores.plan_next(*args, **named).where("column is not null and value is not null"))
        return plans[-1]

    def rule(df, spec, features, train, test, by=None):
        seen.append((df.where(test).select("row_id"), df.where(train).select("row_id")))
        return df.where(test).withColumn("prediction", F.col("AGEP") >= 5)

    from evenhand.plans import calibrate as plan_of_rounds

    monkeypatch.setattr(plan_of_rounds, "plan_next", noted)
    found = calibrate(df, CENSUS, ["AGEP"], (0.3, 0.7), level=level, threshold=2.0, models={"LogisticRegression": rule, "XGBoost": rule})
    assert len(plans) == 2 and len(seen) == 6
    strata = ["SEX", "RAC1P"] if level == "attribute" else []
    for plan, (test, train) in zip([None, *plans], seen[::2]):
        changed = df if plan is None else perturb.apply_modifications(df, CENSUS, plan)
        held = splits.holdout(changed, CENSUS, strata=strata)
        for mine, side in ((test, "is_test"), (train, "not is_test")):
            assert {r[0] for r in mine.collect()} == {r[0] for r in held.where(side).select("row_id").collect()}
    last = perturb.apply_modifications(df, CENSUS, plans[-1])
    assert sorted(map(tuple, found.rows.collect())) == sorted(map(tuple, last.collect()))


def test_models_fit_counted_rows_as_they_fit_all(spark):
    df = splits.holdout(microdata(spark, 2000), CENSUS)
    counted = df.groupBy("client", "SEX", "RAC1P", "MAR", "PINCP", "AGEP", "WKHP", "is_test").agg(F.count("*").alias("times"))
    weighted = FairSpec(CENSUS.sensitive, "PINCP", CENSUS.client, CENSUS.key, weight="times")
    one, two = (sorted(map(tuple, models.evaluate_models(
        rows, spec, ["AGEP", "WKHP"], ~F.col("is_test"), F.col("is_test"), level="value",
        options={"XGBoost": {"rounds": 3, "depth": 2}}).collect())) for rows, spec in ((df, CENSUS), (counted, weighted)))
    assert one == two and len(one) == 4

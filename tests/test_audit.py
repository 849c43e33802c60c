import pytest
from pyspark.sql import functions as F

from corvane.functions import dist as D
from corvane.functions import nested as N
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import audit as A
from corvane.operators import joins as J
from corvane.operators import rank as K
from corvane.operators import stats as S


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_only_target_fills_what_has_none(spark):
    found = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", None), (4, "c", None)], "id long, k string, next_target string")
    targets = spark.createDataFrame([("a", "y"), ("a", "y"), ("b", "y"), ("b", "z")], "k string, t string")
    assert {r.id: r.next_target for r in J.with_only_target(found, targets, ["k"], "t").collect()} == {1: "x", 2: "y", 3: None, 4: None}


def test_rule_status_takes_the_worst_leaf(spark):
    leaves = [
        ("live", "eq", "gain", 0.0, 3.0), ("always", "eq", "gain", -9.0, 9.0), ("mixed", "eq", "gain", -9.0, 9.0), ("mixed", "eq", "gain", 0.0, 3.0), ("far", "eq", "gain", 7.0, 9.0), ("far", "eq", "gain", -9.0, 9.0),
        ("unset", "eq", "q", 0.0, 1.0), ("unset", "eq", "gain", 7.0, 9.0), ("gone", "nope", "q", 0.0, 1.0), ("gone", "eq", "q", 0.0, 1.0), ("words", None, None, None, None), ("there", "eq", None, None, None), ("edge", "eq", "gain", 5.0, 9.0),
    ]
    supports = spark.createDataFrame([("eq", "gain", -5.0, 5.0)], "operator string, parameter string, s_lo double, s_hi double")
    got = dict(rows_of(J.rule_status(spark.createDataFrame(leaves, "rule string, operator string, parameter string, lo double, hi double"), supports, supports.select("operator"))))
    assert got == {"live": "live", "always": "vacuous", "mixed": "live", "far": "dormant_distribution", "unset": "dormant_no_param", "gone": "unreachable_operator", "words": "data_dependent", "there": "data_dependent", "edge": "live"}


def test_parameters_resolve_or_say_why(spark):
    kinds = [("s", "sample", "p", 2.0, 1.0), ("z", "sample", "p", 0.0, 4.0), ("v", "values", None, None, None), ("l", "literal", None, None, None), ("r", "ref", "key", None, None), ("t", "tempo", "beats", None, None), ("e", "each", None, None, None)]
    definitions = spark.createDataFrame(kinds, "at string, kind string, reference string, factor double, offset double")
    occurrences = [(row, at, 5.0, context) for row, context in ((1, {"bpm": 120.0, "key": 3.0}), (2, {}), (3, None)) for at in "szvlrteu"] + [(4, "s", 1.0, {}), (4, "s", 2.0, {})]
    found = J.resolved_parameters(spark.createDataFrame(occurrences, "id long, at string, value double, context map<string,double>"), definitions, ["id"], ["at"], "context")
    got = {(r.id, r.at): (r.status, r.reference, r.resolved_value) for r in found.collect()}
    assert [got[1, at] for at in "szvlrteu"] == [
        ("prior", "p", 2.0), ("fixed", None, 5.0), ("authored", None, 5.0), ("fixed", None, 5.0), ("context", None, 5.0), ("prior", "beats", 10.0), ("no scalar prior", None, 5.0), ("no definition", None, 5.0),
    ]
    assert got[2, "r"][0] == got[3, "r"][0] == "missing context: key" and got[2, "t"][0] == got[3, "t"][0] == "missing tempo" and got[4, "s"][0] == "ambiguous location"
    assert found.count() == len(occurrences)


def test_missing_parameters(spark):
    definitions = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "c")], "recipe string, at string")
    occurrences = spark.createDataFrame([(1, "r", "a"), (1, "r", "a"), (2, "r", "b"), (3, "s", "c"), (4, "t", "a")], "id long, recipe string, at string")
    assert rows_of(J.missing_parameters(definitions, occurrences, ["id"], ["recipe"], ["at"])) == [(1, "b"), (2, "a")]


def test_pairs_by_mode(spark):
    texts = spark.createDataFrame([(1, "in1"), (2, "in2"), (3, "in3")], "k long, input_audio string")
    manifest = spark.createDataFrame([(1, 1, None, "o1", "b1"), (1, 2, "ok", "o2", "b2"), (1, 3, "error", "o3", "b3"), (2, 1, "error", "o4", "b4")], "k long, n long, status string, output_path string, baseline_path string")
    pick = lambda d, *c: rows_of(d.select("k", *c))
    assert pick(J.agent_pairs(texts, manifest, ["k"], ["n"]), "ground_truth_edit_audio", "input_audio") == [(1, "o2", "in1")]
    assert pick(J.agent_pairs(texts, manifest, ["k"], ["n"], "poisoning"), "ground_truth_edit_audio", "input_audio", "original_clean_audio") == [(1, "o2", "b2", "in1")]
    assert pick(J.agent_pairs(texts, None, ["k"], ["n"], "training"), "ground_truth_edit_audio", "input_audio") == [(1, "", "in1"), (2, "", "in2"), (3, "", "in3")]
    with pytest.raises(ValueError):
        J.agent_pairs(texts, manifest, ["k"], ["n"], "training")
    with pytest.raises(ValueError):
        J.agent_pairs(texts, None, ["k"], ["n"])


def test_levels_in_a_mixture(spark):
    rows = spark.createDataFrame([(1, "a", [3.0, 4.0]), (2, "a", [-3.0, 4.0, 0.0]), (3, "a", [0.0, 0.0]), (4, "b", [0.0]), (5, "b", None)], "id long, k string, x array<float>")
    got = {r.id: r for r in V.source_levels(rows, ["k"], "x", 0.01, 0.5).collect()}
    mixture = (64 / 3) ** 0.5  # (0, 8, 0)
    assert got[1].rms_ratio == pytest.approx(12.5**0.5 / mixture) and got[1].active and not got[3].active and not got[4].active and got[5].rms is None
    assert got[4].rms_ratio == 0


def test_send_presence_and_leaks(spark):
    item = "array<struct<effect:string,routing:string>>"
    records = spark.createDataFrame([(1, [("a", "send"), ("a", "send"), ("b", "insert")]), (2, []), (3, None), (4, [("b", "send")])], f"id long, items {item}")
    assert rows_of(S.send_presence(records, "items")) == [("a", 1, 0.25), ("b", 1, 0.25)]
    flags = spark.createDataFrame([(1, "f", "fail", "why", ["z", "a"]), (1, "g", "pass", "", ["a"]), (2, "f", None, "open", None)], "k long, flag string, verdict string, rationale string, tokens array<string>")
    assert [(r.k, r.f, r.f_why, r.f_reason, r.leaks) for r in S.flat_report(flags, ["k"], ["f"], ["fail"], "tokens").orderBy("k").collect()] == [(1, "fail", "why", None, ["a", "z"]), (2, None, None, "open", [])]


def test_fit_counts_everything(spark):
    model = D.component_table(spark, {"p": {"type": "uniform", "low": 0.0, "high": 10.0}})
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("a", 2, 11.0), ("a", 2, None), ("b", 3, None)], "k string, clip long, x double")
    a, b = A.goodness_of_fit(rows, ["k"], "x", model, "clip").orderBy("k").collect()
    assert (a.n, a.distinct_values, a.out_of_support, a.unresolved, a.unique_clips, a.occupied_bins, a.total_bins, a.coverage) == (4, 2, 1, 1, 2, 1, 10, 0.1) and a.cdf_distance == pytest.approx(2 / 3 - 0.1)
    assert (b.n, b.distinct_values, b.unresolved, b.cdf_distance, b.occupied_bins) == (1, 0, 1, None, 0)
    expected = spark.createDataFrame([("u", 0.5), ("v", 0.5)], "x string, p double")
    shares = spark.createDataFrame([("a", "u"), ("a", "w"), ("b", "u"), ("b", "v")], "k string, x string")
    assert rows_of(A.total_variation(shares, ["k"], "x", expected)) == [("a", 0.5), ("b", 0.0)]


def test_counts_below_at_any_number_of_buckets(spark):
    values = [(i * i) % 101 for i in range(400)]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    want = sorted((float(v), values.count(v), sum(w < v for w in values), 400) for v in set(values))
    for buckets in (2, 7, 16, 256):
        assert rows_of(K.counts_below(rows, "x", (), buckets)) == sorted(want, key=repr)


def test_paths(spark):
    cases = {"renders/c1/x.wav": "c1", "./counterfactual//c2/x": "c2", "audio/c3.mp3": "c3", "audio/.hidden": ".hidden", "renders": None, "other/c4": None, "/renders/c5": None, "": None, None: None}
    rows = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.c for r in rows.select("p", T.clip_of_path(F.col("p")).alias("c")).collect()} == cases
    row = spark.range(1).select(
        T.split_of_path(F.lit("d/train-00001-of-00002.parquet")).alias("a"), T.shard_of_path(F.lit("07/x.mp3"), "raw-").alias("b"),
        T.baseline_name(F.lit(True), F.lit(None).cast("string"), F.lit("x")).alias("c"), T.baseline_name(F.lit(None).cast("boolean"), F.lit("p"), F.lit("Lead Vocals!")).alias("d"), T.baseline_name(F.lit(False), F.lit("p"), F.lit(None).cast("string")).alias("e"),
    ).first()
    assert tuple(row) == ("train", "raw-07.tar", "initial__poisoned_initial.wav", "original__lead_vocals.wav", "original.wav")


def test_identifiers_and_mentions(spark):
    registry = spark.createDataFrame([("apply_gain", ["db", "room_size"]), ("reverb", None)], "operator string, params array<string>")
    rows = spark.createDataFrame([(1, "hum_cleanup", "drums"), (1, None, "hum_cleanup"), (2, None, "bass")], "plan long, step string, stem string")
    assert rows_of(T.derive_identifiers(registry, rows, ["plan"], ["step", "stem"])) == [(1, ["apply_gain", "hum_cleanup", "room_size"]), (2, ["apply_gain", "room_size"])]
    said = spark.createDataFrame([(1, "The warm, warm pad", None), (2, "", "warmer Bright")], "id long, user string, assistant string")
    got = rows_of(T.role_mentions(said, ["id"], {"user": "user", "assistant": "assistant"}, {"tone": ["warm", "bright"]}))
    assert got == [(1, "user", "tone", "warm", 10, 14), (1, "user", "tone", "warm", 4, 8), (2, "assistant", "tone", "bright", 7, 13)]


def test_row_audio(spark):
    cases = [(True, "e", "i", False, "c", ("i", "source")), (True, "e", "i", True, "c", ("c", "source")), (True, "e", "i", True, None, ("i", "poisoned_input")), (True, "e", "", None, "c", None), (True, "", "i", False, None, None), (None, "e", "i", False, None, None), (True, "e", "", True, "c", ("c", "source"))]
    rows = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(cases)], "k long, wrapped boolean, edited string, given string, poisoned boolean, clean string")
    got = rows.select("k", N.row_audio(*[F.col(c) for c in ("wrapped", "edited", "given", "poisoned", "clean")]).alias("a")).orderBy("k").collect()
    assert [r.a and (r.a.reference_path, r.a.reference) for r in got] == [c[5] for c in cases]


def test_coverage_counts_a_plan_once_and_where_it_lies(spark):
    data = [(1, 7, "a", 1.0), (1, 7, "a", 3.0), (1, 8, "a", 2.0), (2, 7, "a", None), (3, None, "a", -1.0), (None, 9, "a", 0.0), (3, 7, "b", None), (3, 7, "b", None)]
    rows = spark.createDataFrame(data, "plan_id long, clip_id long, parameter string, value double").repartition(3, "plan_id")
    found = S.coverage(rows, ["parameter"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning(plan_id") == 1
    assert found.columns == ["parameter", "n", "plans", "clips", "low", "high"]
    assert rows_of(found) == [("a", 6, 3, 3, -1.0, 3.0), ("b", 2, 1, 1, None, None)]


def test_plans_are_dealt_once_by_lines(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["coverage_by_operator"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "REPARTITION_BY_NUM" in plan


def test_complete_settings_are_the_first_of_the_last_ones(spark):
    rows = [(1, "A", 7.0, 2, 1), (1, "A", 32.0, 5, 2), (1, "A", 37.0, 5, 3), (1, "R", 3.0, 1, 4), (1, "R", 35.0, 9, 6), (1, "R", 2.0, 9, 7), (2, "A", 1.0, 1, 8), (3, "A", None, 9, 9), (3, "A", 4.0, 1, 10), (3, "R", None, 1, 11)]
    rows += [(4, "A", float("nan"), 2, 12), (4, "A", 1.0, 1, 13), (4, "R", 1.0, None, 14), (5, "N", 1.0, 1, 15), (5, "A", 1.0, 1, 16), (None, "A", 1.0, 1, 17), (None, "R", 2.0, 1, 18)]
    want = [(1, 32.0, 35.0), (3, 4.0, None), (4, "nan", None), (None, 1.0, 2.0)]
    for given in (rows, rows[::-1]):
        table = spark.createDataFrame(given, "k long, p string, v double, o long, place long").coalesce(1)
        got = S.complete_settings(table, ["k"], "p", "v", ["A", "R"], "o", ["place"]).collect()
        assert sorted(((r.k, "nan" if r.A != r.A else r.A, r.R) for r in got), key=repr) == sorted(want, key=repr)


def test_complete_settings_of_lines_alike_are_those_first_in_the_table(spark, tmp_path):
    from corvane.queries.statistics import complete_settings

    kind = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string"
    lines = [(k, k + 5, 3, float(q), flag) for k in range(40) for flag in "AR" for q in (20, 10, 30)]
    for part in range(2):
        spark.createDataFrame(lines[part::2], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    names = sorted(x for x in (tmp_path / "lineitem.parquet").iterdir() if x.suffix == ".parquet")
    first = {}
    for x in names:
        for r in spark.read.parquet(str(x)).collect():
            first.setdefault((r.l_orderkey, r.l_returnflag), r.l_quantity)
    assert {r.l_orderkey: (r.A, r.R) for r in complete_settings(spark, str(tmp_path)).collect()} == {k: (first[k, "A"], first[k, "R"]) for k in range(40)}

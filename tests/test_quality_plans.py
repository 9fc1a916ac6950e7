import time

import pytest
from pyspark.sql import functions as F

from provenant.operators.quality import clean, repairs, score
from provenant.plans import copilots, dag, evidence, export, guard, playbooks, runlog, semantic, transpile
from provenant.sources import registry, store
from provenant.streaming import rates

from .test_operators import churn, emea

DIRTY = [
    (1, "2024-01-15", "AMER", "USA", "yes", "Gold ", "Jan", "Q1", None), (2, "2024-02-10", "EMEA", "uk", "no", "Silver", "Feb", "Q1", None), (3, "2024-03-05", None, "USA", "Y", "gold", "Mar", "Q1", None),
    (4, "2024-04-20", None, "Canada", "N", "Bronze", "Apr", "Q2", None), (5, "2024-05-11", "APAC", "India", "yes", "Silver", "May", "Q2", None), (6, "2024-06-30", "EMEA", "France", "no", "Bronze", "Jun", "Q2", None),
    (7, "2024-07-04", None, "usa", "yes", "Silver", "Jul", "Q3", "x"), (8, "2024-08-19", "EMEA", "Germany", "no", "Bronze", "Aug", "Q3", None), (9, "2024-09-09", "APAC", "Singapore", "Y", "Silver", "Sep", "Q4", None),
    (10, "2024-10-25", "AMER", "Canada", "N", "Bronze", "Oct", "Q4", None), (10, "2024-10-25", "AMER", "Canada", "N", "Bronze", "Oct", "Q4", None),
]


def dirty(spark):
    return spark.createDataFrame(DIRTY, "id int, order_date string, region string, country string, active string, category string, month string, quarter string, notes string")


def test_issues_and_score(spark):
    df = dirty(spark)
    found = {(i.module, i.column): i for i in repairs.detect(df)}
    assert {m for (m, _), i in found.items() if i.critical} == {"date_repair", "duplicate_detection", "quarter_repair", "region_repair"}
    assert found["region_repair", "region"].count == 3 and found["quarter_repair", "quarter"].confidence == 0.70
    assert ("month_repair", "month") not in found and found["country_standardisation", "country"].count == 2
    assert ("null_classification", "notes") in found
    r = score.score_table(df)
    assert r.overall == pytest.approx(63.1) and r.band == "Fair" and r.critical == 4 and r.freshness == "2024-10-25"
    assert r.dimensions["uniqueness"] == 90.91 and r.dimensions["semantic_accuracy"] == 20 and r.dimensions["business_readiness"] == 0


def test_clean_layer(spark):
    layer = clean.CleanLayer(dirty(spark), "dirty_clean")
    out = layer.apply()
    assert out.count() == 10 and "quarter_Clean" not in out.columns and [s.module for s in layer.pending()] == ["quarter_repair"]
    rows = {r["id"]: r for r in out.collect()}
    assert rows[3]["region_Clean"] == rows[4]["region_Clean"] == "AMER" and rows[2]["country_Clean"] == "UK" and rows[1]["region"] == "AMER"
    assert {r["category_Clean"] for r in rows.values()} == {"GOLD", "SILVER", "BRONZE"} and rows[3]["active_Clean"] is True
    assert layer.apply(approve=("quarter_repair",)).filter("id = 9").first()["quarter_Clean"] == "Q3"
    again = clean.CleanLayer.from_manifest(dirty(spark), layer.manifest()).frame()
    assert again.columns == spark.table("dirty_clean").columns
    assert "quarter_Clean" not in layer.undo().columns
    p = clean.CleanLayer(dirty(spark)).preview()
    assert p["after"] > p["before"] == pytest.approx(63.1)
    assert layer.samples(clean.Step("region_repair", "region", 1.0)).count() == 1
    layer.drop()


def test_guardrails_drift_and_text(spark):
    df = dirty(spark)
    g = clean.column_guardrails(clean.CleanLayer(df).apply(), repairs.detect(df), {"id"})
    assert g["id"] == "Blocked" and g["region"] == "Deprecated" and g["region_Clean"] == "Derived" and g["quarter"] == "Unsafe"
    d = clean.schema_drift({"a": "int", "b": "string"}, {"a": "bigint", "c": "string"})
    assert d["renames"] == [("b", "c")] and d["retyped"] == {"a": ("int", "bigint")}
    assert 'AS "x_Clean"' in clean.warehouse_ddl("t", "v", {"x_Clean": "trim(x)"}, True, "snowflake") and "`v`" in clean.warehouse_ddl("t", "v", {})
    compile(clean.audit_script("p", {"x": "trim(y)"}, True), "s", "exec")
    with pytest.raises(ValueError):
        repairs.register(repairs.MODULES["date_repair"])
    assert len(clean.impact(repairs.detect(df))) == len(repairs.detect(df))


@pytest.mark.parametrize("sql", ["SELECT 1", "select 'DROP TABLE x; DELETE FROM y' as t -- INSERT INTO z", "WITH a AS (SELECT 1 x) SELECT * FROM a", "SHOW TABLES", "EXPLAIN SELECT 1", "SELECT update FROM VALUES (1) t(update)"])
def test_reads_are_allowed(spark, sql):
    assert guard.is_read_only(spark, sql)


@pytest.mark.parametrize("sql", ["", "DROP TABLE x", "SELECT 1; SELECT 2", "SELECT 1; DROP TABLE x", "INSERT INTO t VALUES (1)", "CREATE TABLE t AS SELECT 1", "UPDATE t SET a = 1", "DELETE FROM t", "ALTER TABLE t ADD COLUMN a int", "TRUNCATE TABLE t", "CREATE OR REPLACE TEMP VIEW v AS SELECT 1", "SET a=b", "MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE", "nonsense"])
def test_writes_are_refused(spark, sql):
    assert not guard.is_read_only(spark, sql)


def test_runs_have_evidence(spark, tmp_path):
    store = runlog.QueryStore(str(tmp_path))
    e = runlog.Engine(spark, "s", guard.Budget(queries=3), store)
    a = e.run("SELECT id, id / 3 AS v FROM range(10)")
    b = e.run(spark.range(10).select("id", (F.col("id") / 3).alias("v")).repartition(5), "other")
    assert a.result_hash == b.result_hash and a.query_hash != b.query_hash and store.verify(spark, a.query_hash)
    assert runlog.query_hash("select  1\n", "s") == runlog.query_hash("select 1", "s") != runlog.query_hash("select 1", "t")
    e.run("SELECT 1")
    with pytest.raises(guard.BudgetExceeded):
        e.run("SELECT 1")
    with pytest.raises(guard.UnsafeSQL):
        e.run("DROP VIEW x")
    archive = runlog.QueryArchive(str(tmp_path / "a.jsonl"))
    archive.add("s", "m", "select 1", ["x", "y"])
    archive.add("s", "m", "select 2", ["z"])
    assert archive.find("s", "m", ["x"])["text"] == "select 1" and archive.find("s", "n", []) is None and archive.stats()["reused"] == 1


def test_evidence(tmp_path):
    ledger = evidence.Ledger()
    ledger.record(evidence.Claim("a", "a", 1.0, "q", "r"))
    ledger.record(evidence.Claim("b", "b", 1.0, derived_from=("a",)))
    ledger.record(evidence.Claim("c", "c", 1.0))
    assert ledger.orphans() == ["c"] and not evidence.gate_provenance(ledger, ["c"]).passed and evidence.gate_provenance(ledger, ["b"]).passed
    ledger.save(str(tmp_path / "l"))
    assert evidence.Ledger.load(str(tmp_path / "l")).claims == ledger.claims
    with pytest.raises(ValueError):
        ledger.record(evidence.Claim("d", "d", 1.0, derived_from=("a",), tier="causal"))
    assert evidence.grade_layers([evidence.structural(5), evidence.identity([1, 2], 3), evidence.enough_rows(5)])["grade"] == "C"
    r, d = evidence.Rework(), evidence.Defect("metric_ambiguity", "x")
    assert [r.register("g", d), r.register("g", d)] == ["FAIL", "ESCALATE"]
    j = evidence.Journal(str(tmp_path / "j"))
    assert j.add("miss", q=1) and not j.add("miss", q=1) and j.add("hit", q=2) and j.miss_rate() == 0.5
    with pytest.raises(export.NoEvidence):
        export.emit("html", {"title": "t", "numbers": {"c": 1}}, ledger)
    with pytest.raises(KeyError):
        export.emit("fax", {"title": "t", "numbers": {}}, ledger)
    assert all("t" in export.emit(f, {"title": "t", "numbers": {"a": 1.5}}, ledger) for f in export.EXPORTERS)
    assert export.contrast_ratio("#000000", "#ffffff") == pytest.approx(21) and export.spread_labels([1, 1, 5], 2) == [1, 3, 5]


def test_graph(spark, tmp_path):
    log = []
    node = lambda n, deps=(), f=None, **k: dag.Node(n, f or (lambda _: log.append(n) or n), deps, **k)
    nodes = [node("a"), node("b", ("a",)), node("c", ("a",), lambda _: 1 / 0, critical=False, retries=1), node("d", ("b", "c"))]
    assert dag.tiers(nodes) == [["a"], ["b", "c"], ["d"]]
    state = dag.State(str(tmp_path / "s.json"))
    dag.run_graph(None, nodes, state)
    assert state.status == {"a": "done", "b": "done", "c": "failed", "d": "done"} and log == ["a", "b", "d"]
    dag.run_graph(None, nodes, dag.State.load(str(tmp_path / "s.json")))
    assert log == ["a", "b", "d"]
    with pytest.raises(ValueError, match="cycle"):
        dag.tiers([node("a", ("b",)), node("b", ("a",))])
    began = time.time()
    with pytest.raises(dag.StepFailed, match="took more"):
        dag.run_graph(None, [node("slow", f=lambda _: time.sleep(5), timeout_s=0.2)])
    assert time.time() - began < 3
    with pytest.raises(dag.StepFailed, match="one tier"):
        dag.run_graph(None, [node(x, f=lambda _: 1 / 0, critical=False, retries=0) for x in "abc"])


def test_metrics_and_questions():
    assert semantic.resolve_metric("GM").name == "gross_margin"
    assert semantic.metric_from_text("why did our customer churn rate rise?").name == "customer_churn_rate" and semantic.metric_from_text("salesman") is None
    with pytest.raises(semantic.UnknownMetric):
        semantic.resolve_metric("net margin")
    asked = {"what's our conversion rate?": 1, "conversion by device": 2, "why did conversion drop?": 3, "forecast Q4 revenue": 4, "should we A/B test the new checkout?": 5, "top 10 products": 2, "what sample size do we need?": 5, "will revenue reach 1M?": 4}
    assert {q: semantic.classify(q)["level"] for q in asked} == asked
    assert semantic.period_hints("from Q3 to Q1") == {"p1": "Q1", "p2": "Q3"} and semantic.period_hints("q1?")["p1"] == "Q4"
    assert [semantic.plan_run(q)["estimated_queries"] for q in ("what is it", "sales by region", "why?", "forecast sales", "holdout?")] == [35, 43, 80, 43, 35]
    assert semantic.classify("who buys the projector stand")["level"] == 4 and semantic.classify("bypass rate")["level"] == 1


def test_binding(spark):
    from provenant.operators.profile import probes

    found = probes(churn(spark, 500))
    b = semantic.bind(found, list(playbooks.Descriptive.needs), "churn")
    assert b.roles == {"target": ["Churn"], "entity": ["CustomerID"]} and b.ok
    numeric, categorical, _ = semantic.split_features(found, {"Churn", "CustomerID"})
    assert numeric == ["Payment Delay", "Tenure"] and categorical == ["Contract Length", "Gender"]
    bad = semantic.bind(found, list(playbooks.Descriptive.needs), "churn", {"target": "nope"})
    assert not bad.ok and "Fix:" in bad.block_message()


def test_analysis_runs_complete_or_block(spark):
    out = playbooks.run_analysis(runlog.Engine(spark), churn(spark, 6000), "why do customers churn?", "churn", playbook="logistic")
    assert out["status"] == "COMPLETE", (out["error"], out["defects"])
    assert out["found"].feature_plan["binned"]["Payment Delay"] == [16.0, 21.0] and out["model"]["auc"] > 0.6 and out["grade"]["grade"] == "A"
    assert playbooks.recommend(out["found"], "logistic").startswith("Look at Payment Delay")
    blocked = playbooks.run_analysis(runlog.Engine(spark), emea(spark), "why do customers churn?", "emea", playbook="descriptive")
    assert blocked["status"] == "BLOCKED" and "Fix:" in " ".join(blocked["defects"]) and blocked["owners"]
    margin = playbooks.run_analysis(runlog.Engine(spark), emea(spark), "why did gross margin fall from Q1 to Q2?", "emea", overrides={"dimension": "product_line"})
    assert margin["status"] == "COMPLETE" and margin["found"].numbers["mix"] == pytest.approx(margin["found"].numbers["delta"], abs=1e-6)
    assert margin["steps"]["sizing"]["value"] == pytest.approx(abs(margin["found"].numbers["mix"]) * 1000)


@pytest.mark.parametrize("sql, dax", [
    ("sum(revenue)", "SUM(T[revenue])"), ("(sum(revenue) - sum(cogs)) / sum(revenue)", "DIVIDE(SUM(T[revenue]) - SUM(T[cogs]), SUM(T[revenue]))"), ("count(*)", "COUNTROWS(T)"), ("count(distinct id)", "DISTINCTCOUNT(T[id])"),
    ("count(distinct case when s = 'X' then id end)", 'CALCULATE(DISTINCTCOUNT(T[id]), T[s] = "X")'), ("count(*) filter (where a = 1)", "CALCULATE(COUNTROWS(T), T[a] = 1)"), ("sum(a) / nullif(sum(b), 0)", "DIVIDE(SUM(T[a]), SUM(T[b]))"),
    ("case when a > 1 then 1 else 0 end", "IF(T[a] > 1, 1, 0)"), ("a is null", "ISBLANK(T[a])"), ("coalesce(a, 0)", "COALESCE(T[a], 0)"),
])
def test_transpile(spark, sql, dax):
    assert transpile.transpile(spark, sql, "T") == dax


@pytest.mark.parametrize("sql", ["row_number() over (order by a)", "(select 1)", "select 1", "stddev(a)", "sum(", "count(distinct case when a then b else c end)"])
def test_transpile_refuses(spark, sql):
    with pytest.raises(transpile.CannotTranslate):
        transpile.transpile(spark, sql, "T")


def test_transpile_metrics(spark):
    for m in semantic.METRICS.values():
        assert transpile.measure_of(spark, m, "T").expression
    with pytest.raises(transpile.CannotTranslate, match="no column"):
        transpile.transpile(spark, "sum(revenue)", "T", {"x"})
    assert transpile.measure_of(spark, semantic.METRICS["revenue"], "T", overrides={"revenue": "1"}).confidence == "override"
    assert "dataType: int64" in transpile.table_tmdl("T", {"a": "bigint"}, [])


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.tsv").write_text("id\tv\n1\t2.5\n")
    (tmp_path / "w.csv").write_bytes(b"id,name\n1,fran\xe7ais\n2,it\x92s\n")
    (tmp_path / "l.csv").write_bytes(b"id,tag\n1,a\x81b\n")
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    specs = [registry.Spec("a", "csv", str(tmp_path / "a.csv"), derived={"twice": "id * 2"}), registry.Spec("gone", "csv", str(tmp_path / "none.csv"), fallback=str(tmp_path / "a.csv")), registry.Spec("lost", "csv", str(tmp_path / "none.csv")),
             registry.Spec("j", "joined_csv", sources={"aa": str(tmp_path / "a.csv"), "bb": str(tmp_path / "b.tsv")}, view_sql="SELECT aa.*, bb.v FROM aa LEFT JOIN bb USING (id)", extra_views={"jv": "SELECT count(*) n FROM aa"}),
             registry.Spec("cut", "parquet", str(tmp_path / "p.parquet"), row_limit=2), registry.Spec("s", "snowflake")]
    r = registry.Registry(spark, specs)
    assert r.read("a").agg(F.sum("twice")).first()[0] == 6 and "a" in registry.list_tables(spark)
    assert r.resolve("gone").answered_by == "fallback" and r.is_live("a") and not r.is_live("lost")
    assert {x["v"] for x in r.read("j").collect()} == {2.5, None} and spark.table("jv").first()[0] == 2
    with pytest.warns(UserWarning, match="cut to 2"):
        assert r.read("cut").count() == 2
    for name in ("s", "unknown"):
        with pytest.raises(registry.SourceError):
            r.read(name)
    with pytest.warns(UserWarning, match="windows-1252"):
        assert [x["name"] for x in registry.read_path(spark, str(tmp_path / "w.csv")).orderBy("id").collect()] == ["français", "it’s"]
    with pytest.warns(UserWarning, match="ISO-8859-1"):
        assert registry.read_path(spark, str(tmp_path / "l.csv")).first()["tag"] == "a\x81b"
    assert registry.table_schema(spark, "a")[0][0] == "id"


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = rates.windowed_rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r[:3]) for r in spark.table("rates").collect()} == {tuple(r[:3]) for r in rates.windowed_rates(events).collect()}
    q = rates.quality_stream(stream, lambda b: b.agg(F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == events.count()
    assert rates.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_knowledge(spark, tmp_path):
    from provenant.plans import knowledge

    (tmp_path / "g.yaml").write_text("terms:\n  Gross_Margin:\n    meaning: profit over revenue\n    aliases: [GM]\n    owner: finance\n")
    g = knowledge.Glossary.load(str(tmp_path / "g.yaml"))
    assert g.resolve("gm")["term"] == "Gross_Margin" and g.owner("gross_margin") == "finance" and g.resolve("x") is None
    rows = knowledge.metric_dictionary(glossary=g)
    assert len(rows) == 6 and next(r for r in rows if r["metric"] == "gross_margin")["owner"] == "finance"
    c = knowledge.Catalog(str(tmp_path / "c.json"))
    c.put(knowledge.catalog_entry(dirty(spark), "dirty"))
    c.put(knowledge.catalog_entry(emea(spark), "emea", documented=True))
    assert [e["table"] for e in knowledge.Catalog(str(tmp_path / "c.json")).listed("uncertified")] == ["dirty"]
    assert c.entries["emea"]["certification"] == "certified"
    d = knowledge.design_experiment("conversion", 0.10, 0.02, 500)
    assert d["power"] == pytest.approx(0.8, abs=0.01) and d["days"] == -(-2 * d["per_arm"] // 500)
    assert knowledge.close_the_loop(0.1, 0.5, 0.6)["met"] and not knowledge.close_the_loop(0.1, 0.5, 0.45)["met"]


def test_margin_parts_hold_every_segment(spark):
    rows = [(f"s{i:02d}", q, 100.0 + i, 50.0 + (i * k) % 37) for i in range(60) for k, q in ((3, "Q1"), (5, "Q2"))]
    df = spark.createDataFrame(rows, "product_line string, quarter string, revenue double, cogs double")
    found = playbooks.run_analysis(runlog.Engine(spark), df, "why did gross margin fall from Q1 to Q2?", "many", overrides={"dimension": "product_line"})["found"]
    assert len(found.findings) == 51 and found.findings[-1]["segment"] == "10 other segments" and any("10 segments" in x for x in found.notes)
    assert sum(x["total"] for x in found.findings) == pytest.approx(found.numbers["delta"], abs=1e-9)


def test_results_beside_data_and_memory_given_back(spark, tmp_path):
    where = f"file://{tmp_path}/a/b.json"
    assert store.read_text(where) is None
    store.write_text(where, "Füße\n")
    store.write_text(where, "Füße 2\n")
    assert store.read_text(where) == "Füße 2\n"
    with runlog.Engine(spark, "s", store=runlog.QueryStore(f"file://{tmp_path}/q"), most_cached=1) as e:
        a, b = e.run("SELECT 1 AS x UNION ALL SELECT 1"), e.run("SELECT 2 AS x")
        assert not a.df.is_cached and b.df.is_cached and (a.row_count, b.row_count) == (2, 1) and b.scalar() == 2 and a.scalar() == 1
        assert e.store.verify(spark, a.query_hash) and e.store.result(spark, a.result_hash).count() == 2
        with pytest.raises(KeyError):
            e.store.query("none")
    assert not b.df.is_cached
    empty = spark.createDataFrame([], "a int")
    assert runlog.digest(empty)[0] == 0 and runlog.digest(empty) == runlog.digest(empty.repartition(3))


def test_runs_are_listed(tmp_path):
    def fail(_):
        raise RuntimeError("no")

    dag.run_graph(None, [dag.Node("a", lambda _: 1)], dag.State(str(tmp_path / "first.json")))
    with pytest.raises(dag.StepFailed):
        dag.run_graph(None, [dag.Node("a", lambda _: 1), dag.Node("b", fail, ("a",), retries=0)], dag.State(str(tmp_path / "second.json")))
    dag.State(str(tmp_path / "third.json")).save()
    (tmp_path / "other.json").write_text("{}")
    assert {r["run"]: (r["standing"], r["done"], r["failed"]) for r in dag.runs(str(tmp_path))} == {"first": ("complete", ["a"], []), "second": ("failed", ["a"], ["b"]), "third": ("open", [], [])}
    state = dag.State.load(str(tmp_path / "second.json"))
    dag.run_graph(None, [dag.Node("a", fail), dag.Node("b", lambda got: got["a"] + 1, ("a",))], state)
    assert state.outputs["b"] == 2 and next(r for r in dag.runs(str(tmp_path)) if r["run"] == "second")["standing"] == "complete"
    assert dag.runs(str(tmp_path / "nothing")) == []


def test_copilot_decides(spark, tmp_path):
    df = dirty(spark)
    first = copilots.COPILOTS["data-quality"](df, "dirty")
    assert first["pending"] and first["score_after"] >= first["score_before"] and first["decision"] in ("GO-WITH-CAVEATS", "NO-GO") and first["reason"]
    good = copilots.data_quality(spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id int, name string"), "good")
    assert good["applied"] == [] and good["ready"] and good["clean"].count() == 50
    report = score.score_table(df)
    assert copilots.decide(report, [], [], least=101).decision == "NO-GO" and copilots.decide(report, [], ["x:y"], least=0).decision == "NO-GO"
    assert copilots.decide(report, ["x:y"], [], least=0) == copilots.Decision("GO-WITH-CAVEATS", True, "waiting for approval: x:y")
    layer = clean.CleanLayer(df)
    layer.apply()
    j = evidence.Journal(str(tmp_path / "j"))
    assert copilots.remember_repairs(j, "dirty", layer) == len(layer.applied) > 0 == copilots.remember_repairs(j, "dirty", layer)
    assert copilots.recall_repairs(j, "dirty") == tuple(s.name for s in layer.applied) and copilots.recall_repairs(j, "else") == ()
    with pytest.raises(ValueError):
        copilots.copilot("data-quality")(lambda df, source: {})
    assert copilots.next_actions(["a:b"], True, True, True) == ["approve or refuse the waiting repairs: a:b", "watch the driver that was found as a weekly figure"]
    assert len(copilots.next_actions([], False, False)) == 2


def test_measures_and_models(spark):
    made = {m.name: m for m in transpile.bound_measures("Churn", "churned", "customer", ("tenure", "a]b"), "spend")}
    assert made["Entities"].expression == "DISTINCTCOUNT('Churn'[customer])" and made["Entities with Outcome"].expression == "CALCULATE([Entities], 'Churn'[churned] = 1)"
    assert "'Churn'[a]]b]" in made["Mean a]b with Outcome"].expression and made["High Tier Value"].expression == "CALCULATE(SUM('Churn'[spend]), 'RiskScores'[risk_tier] = \"High\")"
    assert "SWITCH(TRUE()" in made["Tier Mismatches"].expression and "High Tier Value" not in {m.name for m in transpile.bound_measures("Churn", "churned", "customer")}
    some, refused = transpile.measures_of_all(spark, "T", {"revenue", "cogs"})
    assert {m.name for m in some} == {"Gross Margin", "Revenue", "Cogs"} and "no column" in refused["customer_churn_rate"] and len(refused) == 3
    tables = {"T": {"id": "bigint"}, "U": {"id": "bigint", "x": "date"}}
    files = transpile.project("Sales", tables, {"T": some}, [(("T", "id"), ("U", "id"))])
    assert set(files) == {f"Sales.SemanticModel/definition/{n}.tmdl" for n in ("model", "tables/T", "tables/U", "relationships")}
    assert "measure 'Revenue'" in files["Sales.SemanticModel/definition/tables/T.tmdl"] and "dataType: dateTime" in files["Sales.SemanticModel/definition/tables/U.tmdl"]
    with pytest.raises(transpile.CannotTranslate):
        transpile.project("Sales", tables, {}, [(("T", "nope"), ("U", "id"))])
    text = export.emit("dax", {"title": "t", "numbers": {}, "measures": some}, evidence.Ledger())
    assert "Revenue =\n    " in text and "-- exact" in text


def test_all_dialects():
    made = clean.ddl_of_all_dialects("t]x", "v", {"c": "trim(c)"}, True)
    assert set(made) == set(clean.DIALECTS) and "[t]]x]" in made["sqlserver"] and made["fabric"].startswith("CREATE OR ALTER VIEW [v]") and '"t]x"' in made["duckdb"]
    with pytest.raises(ValueError):
        clean.warehouse_ddl("t", "v", {}, dialect="none")

"""What keeps the large jobs in proportion to their input: narrow rows before joins, counts without pairs, bounded steps."""

from pyspark.sql import functions as F


def joins(frame):
    """(condition, columns of the left side, columns of the right side) of each join of a frame's optimised plan."""
    found, rest = [], [frame._jdf.queryExecution().optimizedPlan()]
    while rest:
        node = rest.pop()
        children = node.children()
        rest += [children.apply(k) for k in range(children.size())]
        if node.nodeName() == "Join":
            names = [[s.output().apply(k).name() for k in range(s.output().size())] for s in (node.left(), node.right())]
            found.append((node.condition().toString(), *names))
    return found


def test_plants_are_narrow_when_they_meet_their_sites(spark, sf):
    from airgate.plans import details, permit

    for frame in (permit.own_site(spark, sf), details._variants(spark, sf), details._weighed(spark, sf)):
        sides = [left for on, left, _ in joins(frame) if "l_suppkey" in on]
        assert len(sides) == 1 and all(c.startswith("l_") for c in sides[0]) and len(sides[0]) <= 7


def test_the_first_option_is_the_first_by_every_key(spark):
    from airgate.operators import variants

    rows = [
        ("a", 0, 3, 10.5, 2), ("a", 0, 2, 99.25, 5), ("a", 0, 2, 99.25, 3), ("a", 1, 0, 1.0, 1), ("b", 2, 4, 30.0, 6), ("b", 1, 4, 29.999998, 4), ("b", 1, 4, 29.9999984, 2),
        ("c", 0, 1, 0.0, 6), ("d", 0, 4, 999.999999, 1), ("d", 1, 0, 0.0, 2),
    ]
    got = variants.first_option(spark.createDataFrame(rows, "plant_id string, n_stops int, rank int, months_likely double, ord int"), "plant_id")
    want = {}
    for plant, stops, rank, months, place in rows:
        want.setdefault(plant, []).append((stops > 0, rank, round(months, 6), place))
    assert {r["plant_id"]: r["label"] for r in got.collect()} == {p: variants.LABELS[min(held)[3] - 1] for p, held in want.items()}


def test_decisions_in_brief_are_those_in_full(spark, sf):
    from airgate.functions.rules import NA_THRESHOLDS
    from airgate.operators import emissions, pathway
    from airgate.sources import derived

    pte = pathway.design_in_brief(emissions.estimate(derived.plants(spark, sf))).where("pmod(xxhash64(plant_id), 9) = 0")
    grades = [*NA_THRESHOLDS["ozone"], "of no rule"]
    located = pathway.with_overlay(derived.sites(spark, sf).crossJoin(spark.range(8).select(F.col("id").alias("copy"))).withColumn("site_id", F.col("site_id") * 8 + F.col("copy")))
    located = located.withColumns({f"{p}_class": F.try_element_at(F.array(*[F.lit(g) for g in grades]), (F.pmod(F.xxhash64("site_id", F.lit(p)), F.lit(24)) + 1).cast("int")) for p in pathway.DESIGNATED})
    pairs = pte.crossJoin(pathway.in_brief(located, "site_id").join(located, "site_id"))
    d = pathway.decide(pairs.withColumnsRenamed({"kind": "kind_"})).withColumnsRenamed({"kind_": "kind", "rank": "rank_full"})
    for name, sql in pathway.brief().items():
        d = d.withColumn(name, F.expr(sql))
    got = d.agg(
        F.count("*").alias("n"), F.count_if(~F.col("rank").eqNullSafe(F.col("rank_full"))).alias("rank"), F.count_if(~F.col("months").eqNullSafe(F.col("months_likely"))).alias("months"),
        F.count_if(F.col("n_stops") != F.size("stops")).alias("stops"), F.count_if(F.col("tough") == 1).alias("tough"), F.countDistinct("rank").alias("ranks"),
    ).first()
    assert got["n"] > 10_000 and got["tough"] > 100 and got["ranks"] >= 4 and (got["rank"], got["months"], got["stops"]) == (0, 0, 0)


def test_the_sweep_decides_designs_once_for_each_set_of_thresholds(spark, sf):
    from airgate.plans import permit

    full = permit.portfolio(spark, sf).groupBy("rank", F.size("stops").alias("n_stops"), F.col("months_likely").alias("months")).agg(F.count("*").alias("n_pairs"), F.sum("n_plants").alias("n_plants"))
    folded = permit.portfolio_counts(spark, sf).groupBy("rank", "n_stops", "months").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_plants").alias("n_plants"))
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, full.collect()))
    sides = [(a, b) for on, a, b in joins(permit.portfolio_counts(spark, sf)) if "None" in on]
    assert all("site_id" not in a + b for a, b in sides)


def test_candidates_of_a_plant_never_travel_as_rows(spark, sf):
    from airgate.plans import siting

    for job in (siting.flt6_site_outcomes, siting.win1_candidate_sites):
        frame = job(spark, sf)
        sides = [left for on, left, _ in joins(frame) if "l_suppkey" in on]
        assert sides and all(c.startswith("l_") for c in sides[0])
        assert "Window" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_counts_within_equal_brute_force(spark):
    from airgate.functions.geo import haversine
    from airgate.operators import spatial

    sites = spark.range(120).selectExpr("id as site_id", "25D + (id * 7919) % 24000 / 1000 as lat", "-124D + (id * 104729) % 57000 / 1000 as lon")
    features = spark.range(3000).selectExpr("id as feature_id", "if(id % 3 = 0, 'a', 'b') as target", "25D + (id % 1900 * 6151) % 24000 / 1000 as flat", "-124D + (id % 1900 * 86453) % 57000 / 1000 as flon")
    pairs = sites.crossJoin(features).withColumn("km", haversine("lat", "lon", "flat", "flon")).where("km <= 300")
    want = pairs.groupBy("site_id").agg(F.count_if(F.col("km") <= 100).alias("a"), F.count("*").alias("b"))
    got = spatial.counted(sites, features, (100.0, 300.0))
    assert sorted(map(tuple, got.select("site_id", "within_100", "within_300").collect())) == sorted(map(tuple, want.collect()))
    near = pairs.where("km <= 160").groupBy("site_id", "target").agg(F.min(F.struct(F.round("km", 6).alias("r"), "feature_id")).alias("b")).select("site_id", "target", "b.feature_id")
    found = spatial.nearest(sites, features, 160.0)
    assert sorted(map(tuple, found.select("site_id", "target", "feature_id").collect())) == sorted(map(tuple, near.collect()))


def test_features_at_one_place_are_one(spark):
    from airgate.operators import spatial

    sites = spark.range(40).selectExpr("id % 20 + 100 * (id div 20) as site_id", "40D as lat", "-100D + (id % 20) * 0.1 as lon")
    features = spark.range(20_000).selectExpr("id as feature_id", "'t' as target", "40.05D as flat", "-100D + (id % 20) * 0.1 as flon")
    found = spatial.nearest(sites, features, 160.0)
    assert sorted(map(tuple, found.select("site_id", "feature_id").collect())) == sorted((s, s % 100) for s in [*range(20), *range(100, 120)])


def test_deltas_decide_plants_once(spark, sf):
    from airgate.plans import more

    assert sum("l_suppkey" in on for on, _, _ in joins(more.prj24_candidate_deltas(spark, sf))) == 1


def test_written_assessments_are_compressed(spark, sf):
    from airgate.plans import more

    files = more.snk3_assessment_json(spark, sf).inputFiles()
    assert files and all(f.endswith(".gz") for f in files)


def plain_stories(pairs, ids):
    """The least id that each id's pairs lead to."""
    story = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(story[a], story[b])
            changed |= (story[a], story[b]) != (low, low)
            story[a] = story[b] = low
    return story


def news_items(spark, n=260):
    words = "alpha bravo carbon delta echo foxtrot".split()
    rows = []
    for i in range(n):
        k = i * 7919 % 1009
        head = " ".join(w for j, w in enumerate(words) if (k >> j) & 1) if k % 17 else ("To A" if k % 2 else None)
        rows.append((i, None if k % 41 == 0 else f"c{k % 3}", head, None if k % 23 == 0 else k * 5 % 160, f"http://p.com/{k % 90}" if k % 5 == 0 else None, "told", f"m{k % 4}"))
    items = spark.createDataFrame(rows, "item_id long, county string, headline string, day int, url string, summary string, publication string")
    return items.withColumn("published", F.expr("date_add(date'2024-01-01', day)")).drop("day")


def test_stories_are_the_components_of_their_pairs(spark):
    from airgate.operators import news

    items = news_items(spark)
    rows = {r["item_id"]: r for r in items.withColumns({"w": news.tokens(F.col("headline")), "h": news.normalised(F.col("headline")), "u": news.canonical(F.col("url"))}).collect()}

    def alike(a, b, undated):
        days = None if a["published"] is None or b["published"] is None else abs((a["published"] - b["published"]).days)
        both = len({*(a["w"] or ())} & {*(b["w"] or ())})
        return bool(a["w"] and b["w"]) and (undated if days is None else days <= 14) and 10 * both >= 6 * (len(a["w"]) + len(b["w"]) - both)

    met = [(a, b) for a in rows for b in rows if a < b and rows[a]["county"] is not None and rows[a]["county"] == rows[b]["county"]]
    same = lambda a, b, c: rows[a][c] is not None and rows[a][c] == rows[b][c]
    close = {p for p in met if alike(rows[p[0]], rows[p[1]], False)}
    linked = {p for p in met if alike(rows[p[0]], rows[p[1]], True) or same(*p, "h") or same(*p, "u")}
    assert sorted(map(tuple, news.similar(items).collect())) == sorted(close) and sorted(map(tuple, news.same_story(items).collect())) == sorted(linked)
    counted = lambda story: sorted((s, list(story.values()).count(s)) for s in set(story.values()))
    assert sorted((r["story"], r["items"]) for r in news.story_leads(items).collect()) == counted(plain_stories(linked, rows))
    assert sorted(r["items"] for r in news.stories(items).collect()) == sorted(n for _, n in counted(plain_stories(close, rows)))


def test_pairs_of_stories_do_not_travel(spark):
    from airgate.operators import news

    def above_the_last_join(frame):
        node, names = frame._jdf.queryExecution().optimizedPlan(), []
        while node.nodeName() != "Join":
            names.append(node.nodeName())
            node = node.children().apply(0)
        return names

    items = news_items(spark, 30)
    for frame in (news.similar(items), news.same_story(items), news.alike(news.word_sets(items, news.tokens(F.col("headline")))[1])):
        assert set(above_the_last_join(frame)) <= {"Project", "Filter", "Union"}


def test_copies_of_a_headline_are_one_node(spark):
    from airgate.operators import news

    items = spark.range(400).selectExpr("id as item_id", "'c' as county", "'board votes on turbines' || if(id % 2 = 0, '', ' again') as headline", "date_add(date'2024-01-01', cast(id % 100 as int)) as published")
    nodes, edges = news.run_nodes(items)
    assert edges.count() == 1 and nodes.select("node").distinct().count() == 2


def test_pages_are_dealt_out_and_searched_once(spark, sf):
    from airgate.plans import bodies

    frame = bodies.src12_index_points(spark, sf)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and frame.rdd.getNumPartitions() > spark.read.parquet(f"{sf}/customer.parquet").rdd.getNumPartitions()
    assert plan.count("aggregate(") == 1 and plan.count("regexp_extract(") == 1


def test_days_of_a_class_are_runs(spark):
    from airgate.operators import news

    days = spark.range(4000).selectExpr("id % 2 as class_id", "id as item_id", "if(id % 2 = 0, date_add(date'2024-01-01', cast(id % 400 as int)), date_add(date'2024-01-01', cast(id % 20 * 15 as int))) as day")
    got = {}
    for r in news.runs(days, "class_id", undated=False).collect():
        got.setdefault(r["class_id"], []).append((r["lo"] - 19723, r["hi"] - 19723))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(0, 398)], 1: [(d * 15, d * 15) for d in range(1, 20, 2)]}
    with_open = days.unionByName(spark.range(1).selectExpr("0L as class_id", "9999L as item_id", "cast(null as date) as day"))
    whole = [r for r in news.runs(with_open, "class_id", undated=True).collect() if r["class_id"] == 0]
    assert len(whole) == 1 and whole[0]["node"] == 0 and whole[0]["lo"] < 0


def test_headlines_are_read_once_each_and_not_by_item(spark, monkeypatch):
    from airgate.operators import graph, headlines

    kept = []
    monkeypatch.setattr(headlines, "written", lambda df: kept.append(df) or graph.written(df), raising=False)
    items = spark.range(400).selectExpr("id as item_id", "'c' as county", "'Board votes on turbines' || if(id % 2 = 0, '', ' again') as headline", "date_add(date'2024-01-01', cast(id % 100 as int)) as published")
    members, links = headlines.headline_links(items)
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert all("regexp_replace" not in plan(f) for f in (members, *kept[1:], headlines.headline_stories(items)))
    lines = plan(kept[0]).splitlines()
    groups = next(i for i, line in enumerate(lines) if "Aggregate" in line)
    assert "regexp_replace" in "".join(lines[: groups + 1]) and "regexp_replace" not in "".join(lines[groups + 1 :])
    assert [tuple(r) for r in links.collect()] == [(0, 1)] and sorted(map(tuple, members.groupBy("class_id").count().collect())) == [(0, 200), (1, 200)]


def test_streams_read_a_table_in_parts(spark, sf, tmp_path):
    from airgate.plans import registry

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("str4_metered", "str1_daily_volume"):
        got, want = (sorted(map(tuple, registry.QUERIES[name](spark, str(folder)).collect())) for folder in (tmp_path, sf))
        assert got == want and len(got) > 0


def test_options_in_brief_are_those_in_full(spark, sf):
    from airgate.operators import emissions, pathway, variants
    from airgate.plans import details, permit

    # Some designs list a control twice, some have no emission factors.
    twice = F.when(F.pmod(F.xxhash64("plant_id"), F.lit(5)) == 0, F.concat("controls", "controls")).otherwise(F.col("controls"))
    fuel = F.when(F.pmod(F.xxhash64("plant_id"), F.lit(11)) == 0, "diesel").otherwise(F.col("fuel"))
    odd = lambda d: d.where("pmod(xxhash64(plant_id), 3) = 0").withColumns({"controls": twice, "fuel": fuel})
    full = variants.weighed(pathway.decide(emissions.estimate(odd(permit.at_own_site(spark, sf))))).withColumn("n_stops", F.size("stops"))
    told = variants.weighed_in_brief(odd(permit.at_own_site_in_brief(spark, sf)))
    names = [
        "plant_id", "l_suppkey", "mw", "label", "ord", *variants.CHANGED, "run_hours", "enforceable", "base_rank", "base_months", "rank", "pathway", "months_likely", "n_stops",
        "rank_delta", "months_saved", "availability", *(f"{p}_tpy" for p in ("nox", "co", "voc", "pm25")),
    ]
    rows = lambda d: sorted(map(repr, d.select(*names).collect()))
    want = rows(full)
    assert rows(told) == want and len(want) > 5_000 and all(f"label='{x}'" in " ".join(want) for x in variants.OPTIONS)
    # The jobs decide no more than they ask for, and plants meet their options by the number of a small table's design.
    for job in (details.prj25_options_in_full, details.win2_improving_option):
        frame = job(spark, sf)
        assert "triggers" not in frame._jdf.queryExecution().optimizedPlan().toString()
        assert [left for on, left, right in joins(frame) if "design" in on and "ord" in right]


def odd_designs(d):
    """Plants some of which list a control twice, some have no emission factors or hours and sizes that break a rule."""
    twice = F.when(F.pmod(F.xxhash64("plant_id"), F.lit(5)) == 0, F.concat("controls", "controls")).otherwise(F.col("controls"))
    fuel = F.when(F.pmod(F.xxhash64("plant_id"), F.lit(11)) == 0, "diesel").otherwise(F.col("fuel"))
    hours = F.when(F.pmod(F.xxhash64("plant_id"), F.lit(13)) == 0, 9000.0).otherwise(F.col("run_hours"))
    size = F.when(F.pmod(F.xxhash64("plant_id"), F.lit(17)) == 0, 0.0).otherwise(F.col("mw"))
    return d.withColumns({"controls": twice, "fuel": fuel, "run_hours": hours, "mw": size})


def test_months_by_reason_count_plants_before_they_meet_sites(spark, sf):
    from airgate.operators import emissions, pathway
    from airgate.plans import details, permit
    from airgate.sources import derived

    plan = details.agg21_months_by_reason(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "triggers" not in plan and "class_i_aqrv" not in plan
    names = ["gas_reachability", "zoning_posture", "ej_denial_authority", "litigation", "source_aggregation_risk", "psd_increment_consumed"]
    full = pathway.decide(emissions.estimate(odd_designs(permit.at_own_site(spark, sf))))
    want = full.select(F.explode("triggers").alias("t")).where(F.col("t.name").isin(*names)).groupBy("t.name").agg(F.count("*").alias("n"), F.sum("t.months").alias("months"))
    kinds = full.select("plant_id", "fuel", "units", "rank", "major", "gas_pipeline_km", "zoning_posture", "ej", "cases", "increment_no2", "increment_pm25").withColumn("n", F.lit(1))
    assert sorted(map(tuple, pathway.months_by_rule(kinds, *names).collect())) == sorted(map(tuple, want.collect()))
    assert pathway.months_by_rule(kinds.where("false"), *names).count() == 0
    odd = odd_designs(derived.plants(spark, sf))
    kept = emissions.coherent(odd)
    assert sorted(kept.select("plant_id").collect()) == sorted(emissions.estimate(odd).select("plant_id").collect()) and 0 < kept.count() < odd.count()


def test_reasoning_chain_decides_in_brief(spark, sf):
    from airgate.operators import emissions, pathway
    from airgate.plans import more, permit

    assert "triggers" not in more.prj18_reasoning_chain(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    names = ["plant_id", "rank", "months_likely", "n_stops", "nox_tpy", "heat_input"]
    full = pathway.decide(emissions.estimate(odd_designs(permit.at_own_site(spark, sf)))).withColumn("n_stops", F.size("stops")).select(*names)
    told = pathway.planned_in_brief(odd_designs(permit.at_own_site_in_brief(spark, sf))).select(*names)
    want = sorted(map(repr, full.collect()))
    assert sorted(map(repr, told.collect())) == want and len(want) > 1_000

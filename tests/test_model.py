"""Risk model with parameters per study: columns must give what constants give study by study."""

import pytest
from pyspark.sql import functions as F

from lanewise import domain as d
from lanewise.operators import estimates as e
from lanewise.operators import network
from lanewise.plans import model as m
from lanewise.plans import views
from lanewise.sources.tables import study_params

COSTS = {"K": 900.0, "A": 70.0, "B": 5.0, "C": 3.0, "O": 1.0}


@pytest.fixture(scope="module")
def prior(spark):
    cols = [f"{m_}_cv" for m_ in d.MODES] + [f"{x}" for m_ in d.MODES for s in e.KEYS for x in (f"est_{m_}_{s}", f"{m_}_{s}_obs")]
    rows = [(i, 1 + i % 2, *[None if i == 7 else float((i * 7 + j * 3) % 11) / 4 for j in range(len(cols))]) for i in range(8)]
    rows.append((8, 2, *[float("inf") if c.endswith("_cv") else 0.0 for c in cols]))
    return spark.createDataFrame(rows, "i int, study_id int, " + ", ".join(f"{c} double" for c in cols)).cache()


def _rows(df):
    return {r["i"]: r.asDict() for r in df.collect()}


def test_blend_and_costs_by_columns(spark, prior):
    own = spark.createDataFrame(
        [(1, 0.8, 1.0, d.CRASH_COSTS, False), (2, 0.5, 2.0, {s: int(c) for s, c in COSTS.items()}, True)],
        "study_id int, top double, decay double, costs map<string,int>, only boolean",
    )
    rows = prior.join(own, "study_id")
    both = e.crash_costs(e.eb_update(rows, F.col("top"), F.col("decay"), F.col("only")), "costs", F.col("only"))
    got = _rows(both)
    first = _rows(e.crash_costs(e.eb_update(prior.filter("study_id = 1"))))
    second = _rows(e.crash_costs(e.eb_update(prior.filter("study_id = 2"), 0.5, 2.0, True), COSTS, True))
    assert set(got) == set(range(9)) == set(first) | set(second)
    for i, want in (first | second).items():
        for name, value in want.items():
            assert got[i][name] == (None if value is None else pytest.approx(value)), (i, name)
        if i in second:
            assert all(got[i][f"{x}_{mode}_{s}"] is None for x in ("w", "adj") for mode in d.MODES for s in e.KEYS[1:])


@pytest.fixture(scope="module")
def studies_input(spark, make_lines):
    """Two studies on the same ground: a bent road and a crossing one; all crashes of the second are fatal."""
    shapes = [(1, "A St", [(0, 0), (700, 0), (700, 500)]), (2, "B St", [(-200, 90), (900, 90)])]
    roads = make_lines(shapes, study_id=1).unionByName(make_lines(shapes, study_id=2))
    crashes = [
        (s, i, 2015 + i % 6 - 3 * (s - 1), d.MODES[i % 3], "K" if s == 2 else d.SEVERITIES[i % 5], 37.0 * i, float(i % 4) * 9)
        for s in (1, 2) for i in range(24)
    ]
    schema = "study_id int, crash_id int, crash_year int, crash_mode string, crash_severity string, x double, y double"
    return network.dissolve_roads(roads).cache(), spark.createDataFrame(crashes, schema).cache()


def _store(spark, edges, crashes, studies=None):
    sides = [(-500.0, 300.0), (300.0, 2000.0)]
    groups = [
        (s, f"g{i}", [[(a, -900.0), (b, -900.0), (b, 900.0), (a, 900.0)]], *[1.5 + i + s] * 6) for s in (1, 2) for i, (a, b) in enumerate(sides)
    ]
    block_groups = spark.createDataFrame(
        [(s, g, [[tuple(p) for p in ring] for ring in rings], *rest) for s, g, rings, *rest in groups],
        "study_id int, geoid string, rings array<array<struct<x:double,y:double>>>, "
        + ", ".join(f"final_{p}_{mode} double" for p in ("pred", "se") for mode in d.MODES),
    )
    rates = spark.createDataFrame([("X", "Local Road", 0.1, 0.2, 0.3)], "state string, functional_class string, " + ", ".join(f"{x}_fatal_rate double" for x in d.MODES))
    cols = [f"{mode}_{s}" for mode in d.MODES for s in e.KEYS]
    ratios = spark.createDataFrame([("X", *[1.0 + i for i in range(len(cols))])], "state string, " + ", ".join(f"{c} double" for c in cols))
    states = spark.createDataFrame([(1, "X"), (2, "X")], "study_id int, state string")
    return m.ModelStore(edges, crashes, block_groups, rates, ratios, states, studies)


def test_model_by_study_equals_one_run_each(spark, studies_input):
    edges, crashes = studies_input
    studies = study_params(
        spark.createDataFrame(
            [(1, None, None, None, None, None, None), (2, 0.25, 2, 80.0, 0.5, 2.0, {s: c for s, c in COSTS.items()})],
            "study_id int, sliding_window_length double, window_length_ratio int, crash_join_distance double, "
            "bayesian_max_prior_weight double, bayesian_decay double, crash_costs map<string,double>",
        )
    )
    both = m.run_model(_store(spark, edges, crashes, studies), m.ModelParams(years=4)).posterior.cache()
    shown = views.cost_view(both, F.col("crash_costs")["O"])
    names = ["segment_sequence", "length_meters", *[f"total_{x}_cost" for x in d.MODES], "est_mv_a", "mv_k_obs", "adj_ped_k"]
    key = lambda r: tuple(r[:3])
    got = sorted(both.select("study_id", "road_name", *names).collect(), key=key)
    counts = {r[0]: r[1] for r in shown.groupBy("study_id").count().collect()}
    own = {1: m.ModelParams(years=4), 2: m.ModelParams(0.25, 2, join_ft=80.0, max_weight=0.5, decay=2.0, fatal_only=True, years=4, costs=COSTS)}
    for study, params in own.items():
        alone = _store(spark, edges.filter(F.col("study_id") == study), crashes.filter(F.col("study_id") == study))
        posterior = m.run_model(alone, params).posterior.cache()
        want = sorted(posterior.select("study_id", "road_name", *names).collect(), key=key)
        have = [r for r in got if r["study_id"] == study]
        assert len(want) == len(have) > 4
        for a, b in zip(have, want):
            assert [x if x is None or isinstance(x, str) else pytest.approx(x) for x in b] == list(a)
        assert counts[study] == views.cost_view(posterior, params.costs["O"]).count()


def test_shared_parts_are_written_once(spark, studies_input):
    """Later steps read the pieces and the observed counts; copies of their plans would add up in the driver."""
    edges, crashes = studies_input
    store = m.build_windows(_store(spark, edges, crashes), m.ModelParams(state="X"))
    s = m.count_observed(m.assign_mileage(store, m.ModelParams(state="X")), m.ModelParams(state="X"))
    for df in (s.pieces, s.observed):
        assert df._jdf.queryExecution().optimizedPlan().toString().startswith("LogicalRDD")


def test_posteriors_start_from_estimates_that_were_written(spark, studies_input):
    """The driver replans all that follows after each stage, so the roll-up by window is no part of it."""
    edges, crashes = studies_input
    params = m.ModelParams(state="X")
    s = m.estimate_fatal(m.assign_mileage(m.build_windows(_store(spark, edges, crashes), params), params), params)
    assert "effective_mileage" not in s.fatal._jdf.queryExecution().optimizedPlan().toString()


def test_costs_name_each_weight_twice(spark):
    """A view's filter and its columns repeat the costs; fifteen weights a cost fill the driver if each is repeated inside as well."""
    cols = [f"{mode}_cv" for mode in d.MODES] + [f"{x}" for mode in d.MODES for s in e.KEYS for x in (f"est_{mode}_{s}", f"{mode}_{s}_obs")]
    rows = spark.range(1).select(*[F.rand(i).alias(c) for i, c in enumerate(cols)])
    total = e.crash_costs(e.eb_update(rows)).select("total_mv_cost")
    assert total._jdf.queryExecution().optimizedPlan().toString().count("POWER(") == 2 * len(e.KEYS)

"""Draws for a table of requests against one request at a time."""

import random

import pytest

from contrail.plans import draws, laws

K = ["route", "flight_id"]


def libraries(r):
    maybe = lambda x, share=0.85: x if r.random() < share else None
    name = lambda i: ("R", f"F{i:04d}")
    anchors = [(*name(i), r.randrange(4), r.randrange(1, 4), maybe(500.0 * r.randrange(3)), maybe(5.0 * r.randrange(3)), maybe(round(0.05 * r.randrange(4), 6)), maybe(round(0.01 * r.randrange(70, 73), 6)), maybe(r.random()), maybe(r.random(), 0.4)) for i in range(160)]
    descents = [(*name(i), r.randrange(3), 0.7 + r.random() / 4) for i in range(60)]
    level = [(*name(i), r.randrange(3), 0.7 + r.randrange(9) / 100) for i in range(50)]
    starts = [(*name(i), r.randrange(3), r.choice(["A", "B"]), r.choice(["CLIMB", "DESCENT"]), maybe(100.0 + 5 * r.randrange(60))) for i in range(50)]
    transitions = [(*name(i), r.choice(["CLIMB", "DESCENT"]), 5.0 * r.randrange(30, 60)) for i in range(41)]
    return {
        "anchors": (anchors, "route string, flight_id string, gc_bin int, n_mach long, h_pre_bin double, cas_pre_bin double, phi_tod_bin double, mach_bin double, phi_up double, phi_dn double"),
        "descents": (descents, "route string, flight_id string, gc_bin int, phi_d double"), "level": (level, "route string, flight_id string, gc_bin int, mach_bin double"),
        "starts": (starts, "route string, flight_id string, gc_bin int, family string, phase string, start_bin double"), "transitions": (transitions, "route string, flight_id string, phase string, cas_prev_bin double"),
    }


def named(rows, schema):
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return [dict(zip(names, row, strict=True)) for row in rows]


def one(q, lib, value, trials, law, least=5, must=False):
    for columns in trials:
        sub = lib
        if must and columns:
            sub = [x for x in lib if all(q[c] is not None and x[c] == q[c] for c in columns)]
        else:
            for c in columns:
                hit = [x for x in sub if q[c] is not None and x[c] is not None and x[c] == q[c]]
                sub = hit if len(hit) >= least else sub
        pool = sorted((x[value], x["route"], x["flight_id"]) for x in sub if x[value] is not None)
        if pool:
            return pool[(q["seed"] * laws.DRAW_A + q["draw_id"] * laws.DRAW_B + law * laws.DRAW_C) % len(pool)][0]
    return None


def step(x, by):
    return None if x is None else round(x / by) * by


def expected(q, t):
    q = dict(q)
    q["h_pre_bin"], q["cas_pre_bin"] = step(q["h_pre_max"], 500.0), step(q["cas_pre_last"], 5.0)
    drawn = one(q, t["descents"], "phi_d", (("gc_bin",), ()), 1, 1)
    q["phi_d"] = q.get("phi_d") if q.get("phi_d") is not None else drawn
    start = one(q, [x for x in t["starts"] if x["phase"] == "CLIMB"], "start_bin", (("gc_bin", "family"),), 2, must=True)
    begins = sorted(x["cas_prev_bin"] for x in t["transitions"] if x["phase"] == "CLIMB")
    median = (begins[(len(begins) - 1) // 2] + begins[len(begins) // 2]) / 2 if begins else None
    start = start if start is not None else median
    q["start_cas_kt"] = None if start is None else min(max(start, 130.0), 340.0)
    q["n_mach"] = max(1, one(q, t["anchors"], "n_mach", (("gc_bin", "h_pre_bin"),), 3) or 1)
    up = one(q, t["anchors"], "phi_up", (("gc_bin", "h_pre_bin", "cas_pre_bin"), ()), 4)
    q["phi_up"] = 0.18 if up is None else up
    q["mach_level"] = one(q, t["level"], "mach_bin", (("gc_bin",),), 5, must=True)
    q["phi_tod_bin"], q["mach_bin"] = step(q["phi_d"], 0.05), step(q["mach_level"], 0.01)
    q = {k: round(v, 6) if k in ("phi_tod_bin", "mach_bin") and v is not None else v for k, v in q.items()}
    dn = one(q, t["anchors"], "phi_dn", (("gc_bin", "phi_tod_bin", "mach_bin", "n_mach"), ("gc_bin", "phi_tod_bin"), ()), 6)
    q["phi_dn"] = dn if dn is not None else None if q["phi_d"] is None else min(max(q["phi_d"] + 0.05, 0.0), 1.0)
    return {c: q[c] for c in draws.LAWS}


@pytest.mark.parametrize("empty", [False, True])
def test_contexts_are_drawn_as_one_by_one(spark, empty):
    r = random.Random(8)
    t = libraries(r)
    if empty:
        t = {k: ([], schema) for k, (_, schema) in t.items()}
    maybe = lambda x: x if r.random() < 0.8 else None
    requests = [(i, maybe(r.randrange(5)), r.choice(["A", "B", "C", None]), maybe(500.0 * r.randrange(4) + r.randrange(99)), maybe(5.0 * r.randrange(4)), r.randrange(100), i, maybe(None) if i % 3 else 0.5 + i / 1000) for i in range(90)]
    schema = "id long, gc_bin int, family string, h_pre_max double, cas_pre_last double, seed long, draw_id long, phi_d double"
    # Steps of the fitted tables are those of the requests, so they are made the same way here.
    frames = {k: spark.createDataFrame(rows, s) for k, (rows, s) in t.items()}
    frames["anchors"] = frames["anchors"].withColumns({"phi_tod_bin": laws.to_step("phi_tod_bin", 0.05), "mach_bin": laws.to_step("mach_bin", 0.01)})
    got = {x.id: x for x in draws.draw_contexts(spark.createDataFrame(requests, schema), **frames).collect()}
    plain = {k: named(*v) for k, v in t.items()}
    assert len(got) == 90
    for q in named(requests, schema):
        want, have = expected(q, plain), got[q["id"]]
        for c in draws.LAWS:
            assert have[c] == pytest.approx(want[c]) if want[c] is not None else have[c] is None, (q, c)

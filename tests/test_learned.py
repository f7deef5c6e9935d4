import json
import random

from shelfspark.operators import learned

ATTRIBUTES = ("material", "color", "size", "sterile")
WOODS = ["oak", "ash", "white pine"]


def product(rng, i):
    """(name, description, what an answer says)."""
    wood, color = rng.choice(WOODS), rng.choice(["red", "blue"])
    answer = {"material": wood, "size": rng.choice(["small", "large"])}
    name = f"Stool {i} of {wood}"
    if rng.random() < 0.6:
        answer["color"] = color
        name += f", painted {color}"
    elif rng.random() < 0.5:
        name += f", not {color}"
    return name, "A stool.", answer


def tables(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [product(rng, i) for i in range(n)]
    requests = spark.createDataFrame([(f"enrich|{i}", "enrich", list(ATTRIBUTES), a, b) for i, (a, b, _) in enumerate(rows)],
                                     "request_key string, kind string, fields array<string>, name string, description string")
    responses = spark.createDataFrame([(f"enrich|{i}", "enrich", json.dumps(c)) for i, (_, _, c) in enumerate(rows)], "request_key string, kind string, body string")
    return requests, responses, [c for *_, c in rows]


def test_held_out_accuracy_and_abstention(spark):
    requests, responses, truth = tables(spark)
    answered = learned.answered_requests(requests, responses, ATTRIBUTES)
    model, limits = learned.train(answered)
    assert {r.attribute for r in limits.collect()} == {"material", "color"}        # sizes follow from nothing, nobody says sterile
    fresh, _, known = tables(spark, 300, seed=2)
    told = {int(r.request_key.split("|")[1]): json.loads(r.body) for r in learned.learned_responses(fresh, model, limits).collect()}
    assert len(told) == 300 and all(set(t) <= {"material", "color"} for t in told.values())
    assert all(told[i]["material"] == known[i]["material"] for i in told)
    colors = [(t["color"], known[i].get("color")) for i, t in told.items() if "color" in t]
    assert len(colors) > 100 and sum(a == b for a, b in colors) >= 0.9 * len(colors)


def test_counts_of_a_cue(spark):
    requests, responses, truth = tables(spark, 80)
    answered = learned.answered_requests(requests, responses, ATTRIBUTES)
    model = {(r.attribute, r.cue): r for r in learned.learn(answered).collect()}
    oaks = [c for c in truth if c["material"] == "oak"]
    assert model["material", "oak"].support == len(oaks) and abs(model["material", "oak"].precision - len(oaks) / (len(oaks) + 1)) < 1e-12
    assert model["material", "white pine"].value == "white pine"
    stool = [c for c in truth if c.get("color")]
    most = max(sum(c["color"] == v for c in stool) for v in ("red", "blue"))
    assert abs(model["color", "stool"].precision - most / 81) < 1e-12 and ("sterile", "stool") not in model


def test_no_answers_no_prose_and_repeats(spark):
    requests, responses, _ = tables(spark, 30)
    for some in (responses.limit(0), responses.withColumn("body", responses.kind)):
        model, limits = learned.train(learned.answered_requests(requests, some, ATTRIBUTES))
        assert learned.learned_responses(requests, model, limits).collect() == []
    blank = requests.limit(1).selectExpr("request_key", "kind", "fields", "cast(null as string) as name", "'' as description")
    model, limits = learned.train(learned.answered_requests(requests, responses.unionByName(responses), ATTRIBUTES))
    assert learned.learned_responses(blank, model, limits).collect() == []


def test_the_text_is_searched_once_and_not_for_each_word(spark):
    rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(3)),)], "name string").select(learned.cues("name").alias("cues"))
    assert rows.first().cues == ["w0", "w1", "w2", "w0 w1", "w1 w2"]
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1


def test_cues_below_the_bound_do_not_reach_the_requests(spark, monkeypatch):
    requests, responses, _ = tables(spark)
    model, limits = learned.train(learned.answered_requests(requests, responses, ATTRIBUTES))
    whole = learned.confident(learned.predict(requests.select("request_key", "fields", learned.cues("name", "description").alias("cues")), model), limits)
    seen, predict = [], learned.predict
    monkeypatch.setattr(learned, "predict", lambda asked, cues: seen.append(cues) or predict(asked, cues))
    told = {(r.request_key, k, v) for r in learned.learned_responses(requests, model, limits).collect() for k, v in json.loads(r.body).items()}
    assert told == {(r.request_key, r.attribute, r.value) for r in whole.collect()}
    bound = {r.attribute: r.bound for r in limits.collect()}
    kept = seen[0].collect()
    assert 0 < len(kept) < model.count() and all(r.precision >= bound[r.attribute] for r in kept)


def test_times_asked_follow_each_request_s_fields(spark):
    rows = [(f"r{i}", ["a", "b"] if i % 3 else ["b", "b", None], ["x"] if i % 2 else ["x", "y"], {"a": "1", "b": "2"}) for i in range(30)]
    answered = spark.createDataFrame(rows + [("null", None, ["x"], {"a": "1"})], "request_key string, fields array<string>, cues array<string>, answer map<string,string>")
    model = {(r.attribute, r.cue): (r.value, r.support, round(r.precision, 9)) for r in learned.learn(answered).collect()}
    # A field named twice is asked for twice.
    assert model == {("a", "x"): ("1", 31, round(31 / 21, 9)), ("b", "x"): ("2", 30, round(30 / 41, 9)),
                     ("a", "y"): ("1", 15, round(15 / 11, 9)), ("b", "y"): ("2", 15, round(15 / 21, 9))}

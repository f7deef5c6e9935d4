"""Attribute values learnt from answered requests: a decision list of cues, with abstention.

A cue is a word of a request's prose, or two words that follow each other. For each attribute the model keeps a cue's most
frequent answer and its precision: how often that answer came when the cue was there and the attribute was asked for, an
answer without the attribute counting against it. A request takes the value of its most precise cue, and only above a
precision that was right often enough on requests held out. All of it is counts and joins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ENRICHMENT_ATTRIBUTES
from ..functions.answers import one_answer
from ..functions.products import compute_once
from ..plans.scratch import materialize
from .gapfill import response_map, sanitise_attributes

#: Answers a cue needs to speak, and held-out answers a bound on precision needs to count.
LEAST = 5
#: Right answers wanted among those above the bound; steps in which bounds are tried; parts of the requests, one held out.
TARGET, STEPS, PARTS = 0.9, 20, 5


def cues(*prose: str) -> Column:
    """Distinct lower-case words of the columns, and neighbours joined by a blank."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *prose)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    pairs = lambda ws: F.transform(ws, lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1)))
    # An array of one, so that the text is searched once and not again for each word.
    return F.get(F.transform(F.array(words), lambda ws: F.array_distinct(F.array_compact(F.concat(ws, pairs(ws))))), 0)


def with_cues(requests: DataFrame, *keep: str) -> DataFrame:
    """`keep` and the cues of the prose, which are found once per row."""
    return compute_once(requests, [cues("name", "description").alias("cues")], keep)


def part_of(key: str = "request_key", parts: int = PARTS) -> Column:
    """A part number that follows from the key alone."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(parts))


def answered_requests(requests: DataFrame, responses: DataFrame, attributes=ENRICHMENT_ATTRIBUTES) -> DataFrame:
    """request_key, fields, cues, answer (map of attributes) of the enrichment requests that have an answer. Stored."""
    answers = one_answer(responses.filter("kind = 'enrich'")).select(
        "request_key", sanitise_attributes(response_map(F.col("body"), attributes), attributes).alias("answer"))
    # Found after the join: the prose that is shuffled is shorter than its cues.
    asked = requests.filter("kind = 'enrich'").select("request_key", "fields", "name", "description")
    return materialize(with_cues(asked.join(answers, "request_key"), "request_key", "fields", "answer").select("request_key", "fields", "cues", "answer"), "answered")


def learn(answered: DataFrame, least: int = LEAST) -> DataFrame:
    """attribute, cue, value, support, precision of every cue with `least` answers of one value; of several values the most frequent, then the smallest."""
    given = answered.select(F.explode("answer").alias("attribute", "value"), "cues").select("attribute", "value", F.explode("cues").alias("cue"))
    given = given.groupBy("attribute", "cue", "value").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
    best = given.groupBy("attribute", "cue").agg(F.min_by(F.struct("value", "support"), F.struct(-F.col("support"), "value")).alias("best"))
    # Requests mostly ask for the same fields: counted by cue and fields, not by each field.
    asked = answered.select("fields", F.explode("cues").alias("cue")).groupBy("fields", "cue").agg(F.count(F.lit(1)).alias("n"))
    named = F.array_size(F.filter("fields", lambda f: f == F.col("attribute")))
    times = best.join(asked, "cue").groupBy("attribute", "cue").agg(F.first("best").alias("best"), F.sum(F.col("n") * named).alias("times"))
    return times.filter(F.col("times") >= least).select(
        "attribute", "cue", "best.value", "best.support", (F.col("best.support") / (F.col("times") + 1)).alias("precision"))


def predict(asked: DataFrame, model: DataFrame) -> DataFrame:
    """request_key, attribute, value, precision: the value of the most precise cue, of equals the most frequent one, then the smallest value."""
    found = asked.select("request_key", "fields", F.explode("cues").alias("cue")).join(model, "cue").filter(F.array_contains("fields", F.col("attribute")))
    order = F.struct(-F.col("precision"), -F.col("support"), "value")
    best = found.groupBy("request_key", "attribute").agg(F.min_by(F.struct("value", "precision"), order).alias("best"))
    return best.select("request_key", "attribute", "best.value", "best.precision")


def bounds(predicted: DataFrame, answered: DataFrame, target: float = TARGET, least: int = LEAST) -> DataFrame:
    """attribute, bound: the lowest precision from which on predictions for answered requests are right in `target` of all cases.

    A prediction for an attribute that the answer lacks is wrong. Attributes without such a bound are absent: they abstain.
    """
    right = F.coalesce(F.try_element_at("answer", F.col("attribute")) == F.col("value"), F.lit(False))
    judged = predicted.join(answered.select("request_key", "answer"), "request_key")
    steps = judged.groupBy("attribute", F.floor(F.col("precision") * STEPS).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"))
    # Some twenty steps per attribute: each is joined to those at or above it.
    above = steps.select(F.col("attribute").alias("_attribute"), F.col("step").alias("_step"), F.col("n").alias("_n"), F.col("right").alias("_right"))
    sums = steps.join(above, (F.col("attribute") == F.col("_attribute")) & (F.col("_step") >= F.col("step"))).groupBy("attribute", "step").agg(
        F.sum("_n").alias("n"), F.sum("_right").alias("right"))
    good = sums.filter((F.col("n") >= least) & (F.col("right") >= F.lit(target) * F.col("n")))
    return good.groupBy("attribute").agg((F.min("step") / F.lit(STEPS)).alias("bound"))


def confident(predicted: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of predictions, or cues of a model, whose precision reaches the bound of their attribute."""
    return predicted.join(limits, "attribute").filter("precision >= bound").drop("bound")


def train(answered: DataFrame, target: float = TARGET, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(model, bounds), stored: cues from all parts but one, bounds from that one."""
    held_out = part_of() == 0
    model = materialize(learn(answered.filter(~held_out), least), "model")
    return model, materialize(bounds(predict(answered.filter(held_out), model), answered, target, least), "bounds")


def learned_responses(requests: DataFrame, model: DataFrame, limits: DataFrame) -> DataFrame:
    """Answers to enrichment requests in the shape of the response table; requests about which the model is unsure have none."""
    asked = with_cues(requests.filter("kind = 'enrich'"), "request_key", "fields")
    # Cues below the bound are left out first: the best one is above it exactly if any is.
    sure = predict(asked, confident(model, limits))
    entries = F.array_sort(F.collect_list(F.struct("attribute", "value")))      # one for each attribute at most
    return sure.groupBy("request_key").agg(F.to_json(F.map_from_entries(entries)).alias("body")).select("request_key", F.lit("enrich").alias("kind"), "body")


def accuracy(predicted: DataFrame, answered: DataFrame) -> DataFrame:
    """attribute, n_predicted, n_right over the requests that have an answer."""
    right = F.coalesce(F.try_element_at("answer", F.col("attribute")) == F.col("value"), F.lit(False))
    judged = predicted.join(answered.select("request_key", "answer"), "request_key")
    return judged.groupBy("attribute").agg(F.count(F.lit(1)).alias("n_predicted"), F.count_if(right).alias("n_right"))

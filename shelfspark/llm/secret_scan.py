"""Secret scans: candidates from long key-like runs and named assignments, false positives removed by a random forest, in DataFrame operations only.

Labelled findings come from rules that are sure: provider formats and named values that no word looks like are secrets, plain letter
or digit runs, named words and placeholders, and values named as checksums are not. They label rows to learn from only; of the
results, provider formats alone are sure, as they say themselves what they are. The forest learns from length, character transitions, dictionary coverage, path and
neighbouring words, and decides on all candidates, the many that no rule knows included.
"""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.products import compute_once
from ..plans.scratch import materialize, scratch_path
from .frames import free_names

LEAST = 16                  # shortest run in the open; what stands there is longer than words
LEAST_NAMED = 4             # shortest value of a named assignment
THRESHOLD = 0.5
#: Labelled findings of each label to learn from, at most.
MAX_FINDINGS = 4000
TREES = 30
DEPTH = 6
SEED = 7
#: A word is in the dictionary if it makes up this share of all words; so there are 20,000 at most, whatever the corpus.
DICTIONARY_SHARE = 5e-5
REDACTED = "[REDACTED]"

_RUN = r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % LEAST
# Formats of public providers (fixed values).
_PROVIDER = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_\-]{35})$"
_ASSIGNMENT = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private)[a-z_\-]*[\"']?\s*[:=]>?\s*"
_NAMED = rf"(?i){_ASSIGNMENT}[\"']?$"
# What an assignment gives: all between quotes on a line, else all up to a blank without the marks that close a phrase.
_VALUE = r"""(?:(")([^\n]*?[^\\\n])(?=")|(')([^\n]*?[^\\\n])(?=')|(["']?)(\S*[^\s,;.)\]}"']))"""
_MARK = "\x01\x02shelf\x02\x01"     # stands around values while a text is split
_PASSWORD = r"(?i)(?:pass(?:word|wd|phrase)?|pwd)[a-z_\-]*[\"']?\s*[:=]>?\s*[\"']?$"
_PLACEHOLDER = r"(?i)^\$[{(]|^<[a-z_ -]+>?$|^\{\{|^%[(]|[A-Za-z_]\(|://|^(?:none|null|nil|true|false|undefined|required|optional)$"
_NAME = r"(?i)pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|credential|bearer|private"
_CHECKSUM = r"(?i)\b(?:sha\d*|md5|crc|checksum|digest|commit|revision|uuid|guid|etag|build|version|id)\b"
_SAMPLE = r"(?i)(?<![a-z])(?:example|sample|dummy|fixture|placeholder|changeme)(?![a-z])|(?<![a-z0-9])test(?![a-z0-9])|xxxx"
FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "distinct_chars", "class_changes", "letter_to_digit", "digit_to_letter", "lower_to_upper",
            "hex_only", "longest_letters", "coverage", "slashes", "path_sample", "named", "assigned", "quoted", "checksum", "neighbour_sample")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, row, path, word, value, before, after: every key-like run of LEAST characters or more, and every whole value of a named
    assignment of LEAST_NAMED or more that is no such run itself.

    `word` counts white-space words of the text from 0; `before` holds the two words before and what stands before the run in
    its own word; `path` is the column `source` where there is one. Null and empty texts hold none.
    """
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    text = F.col("text").cast("string")
    # Without compute_once later steps would copy the split into every element's test.
    base = compute_once(docs, [F.split(F.coalesce(text, F.lit("")), r"\s+").alias("w")], [F.col("doc_id"), F.xxhash64(text).alias("row"), path.alias("path")])
    at = f"filter(sequence(0, size(w) - 1), i -> octet_length(w[i]) >= {LEAST} and w[i] rlike '{_RUN}')"
    around = ("inline(transform(at, i -> named_struct('word', i, 'token', w[i], 'front', concat_ws(' ', get(w, i - 2), get(w, i - 1)), "
              "'after', coalesce(get(w, i + 1), ''))))")
    tokens = base.withColumn("at", F.expr(at)).select("doc_id", "row", "path", F.expr(around))
    runs = tokens.select("*", F.explode(F.array_distinct(F.regexp_extract_all("token", F.lit(f"({_RUN})"), 1))).alias("value"))
    runs = runs.select("doc_id", "row", "path", F.col("word").cast("long").alias("word"), "value",
                       F.concat_ws(" ", "front", F.expr("substring_index(token, value, 1)")).alias("before"),
                       "after")
    return runs.unionByName(_assigned(docs, path, text))


def _assigned(docs: DataFrame, path: Column, text: Column) -> DataFrame:
    """The values of named assignments, with the columns of candidates()."""
    marked = F.regexp_replace(text, f"(?i)({_ASSIGNMENT}){_VALUE}", f"$1$2$4$6{_MARK}$3$5$7{_MARK}")
    parts = F.split(marked, _MARK)      # what stands before a value and the value in turns, at last what stands after
    base = compute_once(docs, [parts.alias("p")], [F.col("doc_id"), F.xxhash64(text).alias("row"), path.alias("path")]).filter("size(p) > 1")
    base = compute_once(base, [F.expr(r"transform(p, x -> regexp_count(x, '\\s+'))").alias("blanks")], [F.col(c) for c in base.columns])
    each = ("inline(transform(sequence(1, size(p) - 2, 2), i -> named_struct('word', aggregate(slice(blanks, 1, i), 0L, (s, x) -> s + x), 'value', p[i], "
            "'front', p[i - 1], 'rest', p[i + 1])))")
    found = base.select("doc_id", "row", "path", F.expr(each)).filter((F.length("value") >= LEAST_NAMED) & ~F.col("value").rlike(f"^{_RUN}$"))
    front = F.split("front", r"\s+")
    before = F.array_join(F.slice(front, F.greatest(F.size(front) - 2, F.lit(1)), F.lit(3)), " ")
    return found.select("doc_id", "row", "path", "word", "value", before.alias("before"), F.regexp_extract("rest", r"^\S*\s+(\S*)", 1).alias("after"))


def dictionary(docs: DataFrame) -> DataFrame:
    """Letter trigrams of the corpus's frequent words: (gram); 26**3 at most. Words are counted over all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("word")).filter("length(word) between 3 and 16")
    counted = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counted.agg(F.sum("n").alias("n")).first().n or 0
    frequent = counted.filter(F.col("n") >= max(2, DICTIONARY_SHARE * total))
    return frequent.select(F.explode(F.expr("transform(sequence(1, length(word) - 2), i -> substring(word, i, 3))")).alias("gram")).distinct()


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("value", pattern, "")) / F.col("length")


def features(found: DataFrame, grams: DataFrame) -> DataFrame:
    """`found` with the columns FEATURES, all double."""
    known = sorted(r.gram for r in grams.collect())     # 26**3 at most
    # One flag for each of the 26**3 trigrams, as a string that is split once into a constant array.
    flags = ["0"] * 26**3
    for g in known:
        flags[(ord(g[0]) - 97) * 676 + (ord(g[1]) - 97) * 26 + ord(g[2]) - 97] = "1"
    code = lambda i: f"(ascii(substring(low, i + {i}, 1)) - 97)"
    covered = (f"aggregate(filter(sequence(1, length(low) - 2), i -> substring(low, i, 3) rlike '^[a-z]{{3}}$'), 0, (s, i) -> s + "
               f"int(element_at(known, {code(0)} * 676 + {code(1)} * 26 + {code(2)} + 1)))")
    out = found.withColumn("length", F.length("value")).withColumn("low", F.lower("value"))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "U"), "[0-9]", "9")
    out = out.withColumn("kinds", kinds).withColumn("known", F.split(F.lit("".join(flags)), "(?<=.)(?=.)"))
    count = lambda pattern: F.regexp_count("kinds", F.lit(pattern)) / F.col("length")
    has = lambda column, pattern: F.coalesce(F.col(column), F.lit("")).rlike(pattern)
    columns = {
        "length": F.col("length"),
        "digits": count("9"), "uppers": count("U"), "lowers": count("a"), "symbols": count("-"),
        "distinct_chars": F.size(F.array_distinct(F.split("value", "(?<=.)(?=.)"))) / F.col("length"),
        "class_changes": count(r"(.)(?=.)(?!\1)"),
        "letter_to_digit": count("[aU](?=9)"), "digit_to_letter": count("9(?=[aU])"), "lower_to_upper": count("a(?=U)"),
        "hex_only": F.col("value").rlike("^[0-9a-f]+$") | F.col("value").rlike("^[0-9A-F]+$"),
        "longest_letters": F.array_max(F.transform(F.split("value", "[^A-Za-z]+"), F.length)),
        "coverage": F.expr(covered) / F.greatest(F.col("length") - 2, F.lit(1)),
        "slashes": F.regexp_count("value", F.lit("/")),
        "path_sample": has("path", _SAMPLE), "named": has("before", _NAME), "assigned": has("before", r"[:=]\s*[\"']?$"),
        "quoted": has("before", r"[\"']$"), "checksum": has("before", _CHECKSUM),
        "neighbour_sample": has("before", _SAMPLE) | has("after", _SAMPLE) | has("value", _SAMPLE),
    }
    flags_ = {"hex_only", "path_sample", "named", "assigned", "quoted", "checksum", "neighbour_sample"}
    values = [F.coalesce((c.cast("int") if n in flags_ else c).cast("double"), F.lit(0.0)).alias(n) for n, c in columns.items()]
    return out.select(*found.columns, *values)


def rule_label(found: DataFrame) -> Column:
    """1 for a sure secret, 0 for a sure false positive, null where no rule knows. `found` has the columns FEATURES."""
    value, before = F.col("value"), F.col("before")
    classes = sum((value.rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]")), F.lit(0))
    # Two digits, three kinds of characters, or in a password one digit or a mark that words do not have.
    odd = value.rlike("[0-9].*[0-9]") | (classes >= 3) & ~value.rlike(r"\s") | before.rlike(_PASSWORD) & value.rlike(r"^\S*[^\sA-Za-z\-'./_]\S*$")
    named = before.rlike(_NAMED) & odd & ~value.rlike(_SAMPLE) & ~value.rlike(_PLACEHOLDER)
    # Letter runs are words; runs of digits alone are card, account and phone numbers: personal, but no credentials.
    plain = ~(value.rlike("[0-9]") & value.rlike("[A-Za-z]")) & ~before.rlike(_NAMED)
    word = before.rlike(_NAMED) & (value.rlike(_PLACEHOLDER) | value.rlike("^[A-Z]?[a-z]+$") & ~before.rlike("[\"']$") & (F.col("coverage") >= 1))
    provider = value.rlike(_PROVIDER) & ~value.rlike(_SAMPLE)
    return F.when(provider, 1).when(before.rlike(_CHECKSUM) & ~before.rlike(_NAMED), 0).when(named, 1).when(plain | word, 0)


@dataclass
class SecretModel:
    """A fitted forest; None where one of the labels had no finding, and the rules decide alone."""

    forest: PipelineModel | None


def train(labelled: DataFrame, max_findings: int = MAX_FINDINGS) -> SecretModel:
    """`labelled` has the columns FEATURES, value and label (0 or 1; nulls are ignored).

    Equal values count once, so that a copied text does not outvote others; of each label the `max_findings` with the smallest
    hash are taken.
    """
    usable = labelled.filter("label is not null").dropDuplicates(["value", "label"])
    parts = [usable.filter(F.col("label") == y).orderBy(F.xxhash64("value"), "value").limit(max_findings) for y in (0, 1)]
    chosen = materialize(parts[0].unionByName(parts[1]).withColumn("label", F.col("label").cast("double")).select(*FEATURES, "label"), "findings")
    if chosen.select("label").distinct().count() < 2:
        return SecretModel(None)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    folder = scratch_path(labelled.sparkSession, "forest")
    # Written and read again: a fresh model does not hold the session that trained it, and outlives the executors.
    forest.fit(assembled.transform(chosen)).write().save(folder)
    return SecretModel(PipelineModel([assembled, RandomForestClassificationModel.load(folder)]))


def classify(found: DataFrame, model: SecretModel) -> DataFrame:
    """`found` (with FEATURES and label) without the features, plus score (0 to 1)."""
    kept = [c for c in found.columns if c not in FEATURES and c != "score"]
    if model.forest is None:
        return found.select(*kept, F.coalesce(F.col("label").cast("double"), F.lit(0.0)).alias("score"))
    scored = model.forest.transform(found)
    return scored.select(*kept, vector_to_array("probability")[1].alias("score"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row (hash of the text), word, value, kind, score: the candidates that the forest takes for secrets.

    `docs` needs doc_id and text, and may have source; other columns are ignored. `labelled` gives findings of your own (FEATURES,
    value, label); without it the rules label the candidates of `docs`. Repeated rows give repeated findings; a null doc_id
    stays null.
    """
    found = features(candidates(docs), dictionary(docs))
    found = found.withColumn("label", rule_label(found))
    found = materialize(found, "candidates")
    scored = classify(found, train(found if labelled is None else labelled))
    sure = F.col("value").rlike(_PROVIDER) & (F.col("label") == 1)
    scored = scored.withColumn("score", F.when(sure, 1.0).otherwise(F.col("score")))
    kind = F.when(F.col("value").rlike(_PROVIDER), "provider").when(F.col("before").rlike(_NAMED), "named").otherwise("unnamed")
    return scored.filter(F.col("score") >= threshold).select("doc_id", "row", "word", "value", kind.alias("kind"), "score")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, word, kind, length, value_sha256, score of every secret; the secret itself stays out of the report."""
    return scan(docs).select("doc_id", "word", "kind", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score")


def redact(docs: DataFrame) -> DataFrame:
    """`docs`, same columns and rows, each secret in `text` replaced by REDACTED where it was found; `n_chars` follows where there is one.

    The same characters elsewhere stay. A secret of several words goes with the blanks between them. Null and empty texts stay;
    any column names may stand beside doc_id and text.
    """
    doc, row, secrets = free_names(docs, "doc", "row", "secrets")
    found = scan(docs).select("doc_id", "row", "word", F.posexplode(F.split("value", r"\s+")).alias("at", "part"))
    parts = F.collect_set(F.struct((F.col("word") + F.col("at")).alias("word"), (F.col("at") > 0).alias("more"), F.regexp_replace("part", r"([^\p{L}\p{N}])", r"\\$1").alias("part")))
    found = materialize(found.filter("part <> ''").groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.sort_array(parts, False).alias(secrets)), "secrets")
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found[doc]) & (F.xxhash64(F.col("text").cast("string")) == found[row]), "left")
    # Words and the blanks between them in turns; in a word only what stands free of other letters and digits goes.
    clean = F.expr(f"""array_join(transform(arrays_zip(split(cast(text as string), '\\\\s+'), regexp_extract_all(cast(text as string), '\\\\s+', 0)),
        (x, i) -> concat(aggregate(filter({secrets}, s -> s.word = i), x.`0`, (t, s) ->
            regexp_replace(t, concat('(?<![A-Za-z0-9])', s.part, '(?![A-Za-z0-9])'), if(s.more, '', '{REDACTED}'))),
            if(exists({secrets}, s -> s.more and s.word = i + 1), '', coalesce(x.`1`, '')))), '')""")
    text = F.when(F.col(secrets).isNull(), F.col("text")).otherwise(clean)
    columns = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col(secrets).isNull(), F.col("n_chars")).otherwise(F.length(clean).cast(kind)).alias("n_chars")
    return joined.select(*[columns.get(c, docs[c]) for c in docs.columns])

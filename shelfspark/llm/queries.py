"""Registered queries of the operators for training data, and their SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, language, licenses, periodic_runs, pieces, repetition, secret_scan, simhash, substring_dedup, topk, toxicity, warc

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"     # a public vocabulary, read where it lies


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digests(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as fingerprint", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text and their number, and the length and digest of the text that they decode to."""
    docs, model = _table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.load_pieces(PIECE_MODEL)
    coded = pieces.encode(docs, model, seed=1)
    spelt = pieces.decode(coded.withColumn("again", F.col("pieces")), model, "again", "decoded")
    return spelt.select("doc_id", "pieces", F.size("pieces").alias("n_pieces"), F.length("decoded").cast("long").alias("n_decoded"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's response with its metadata and conversion record."""
    return warc.build(_table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k_embeddings(_table(spark, sf_dir, "embeddings"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge_documents(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_toxicity, op3_sentencepiece, op4_language_id, op5_decontamination, op6_license_scan, op7_simhash_near_dedup,
    op8_warc_derivatives, op9_secret_scan, op10_exact_top_k, op11_quality_rules, op12_collocations, op13_periodic_runs,
)}

ORACLES = {
    "op1_substring_dedup": r"""
        with words as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        windows as (
            select doc_id, unnest(range(1, len(w) - 11)) as p, w from words where len(w) >= 13),
        keyed as (
            select doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') as seq from windows),
        late as (
            select doc_id, p from (select doc_id, p, min(doc_id) over (partition by seq) as earliest from keyed)
            where earliest < doc_id),
        gone as (select distinct doc_id, unnest(range(p, p + 13)) as i from late),
        each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words),
        kept as (
            select e.doc_id, string_agg(e.word, ' ' order by e.i) as text, count(*) as n
            from each e anti join gone g on e.doc_id = g.doc_id and e.i = g.i group by e.doc_id)
        select s.doc_id, len(s.w)::bigint as n_words, (len(s.w) - coalesce(k.n, 0))::bigint as n_removed,
            sha256(coalesce(k.text, '')) as kept_sha256
        from words s left join kept k on s.doc_id = k.doc_id""",
    "op10_exact_top_k": """
        with v as (
            select vec_id, [floor(64 * x::double)::bigint for x in embedding] as v from embeddings
            where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        scored as (
            select q.vec_id as query_id, c.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)])::bigint as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
        ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
        select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 20""",
    "op11_quality_rules": r"""
        with words as (
            select row_number() over () as id, doc_id, coalesce(text, '') as text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        sizes as (
            select id, doc_id, len(w)::bigint as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars,
                len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols from words),
        lines as (select id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from words),
        late as (
            select id, list_sum([length(x) for x in regexp_extract_all(line, '[^\x20\x09-\x0D]+')]) as chars,
                row_number() over (partition by id, line order by i) as nth
            from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
        line_sums as (select id, count(*) as n_dup_lines, sum(chars) as dup_line_chars from late where nth > 1 group by id),
        each as (select id, unnest(w) as word, unnest(range(len(w))) as i from words),
        ahead as (
            select id, i, word, lead(word, 1) over e as w1, lead(word, 2) over e as w2, lead(word, 3) over e as w3, lead(word, 4) over e as w4,
                lead(word, 5) over e as w5, lead(word, 6) over e as w6, lead(word, 7) over e as w7, lead(word, 8) over e as w8, lead(word, 9) over e as w9
            from each window e as (partition by id order by i)),
        runs as (
            select id, i, 3 as n, concat_ws(' ', word, w1, w2) as run from ahead where w2 is not null
            union all select id, i, 5, concat_ws(' ', word, w1, w2, w3, w4) from ahead where w4 is not null
            union all select id, i, 6, concat_ws(' ', word, w1, w2, w3, w4, w5) from ahead where w5 is not null
            union all select id, i, 7, concat_ws(' ', word, w1, w2, w3, w4, w5, w6) from ahead where w6 is not null
            union all select id, i, 8, concat_ws(' ', word, w1, w2, w3, w4, w5, w6, w7) from ahead where w7 is not null
            union all select id, i, 9, concat_ws(' ', word, w1, w2, w3, w4, w5, w6, w7, w8) from ahead where w8 is not null
            union all select id, i, 10, concat_ws(' ', word, w1, w2, w3, w4, w5, w6, w7, w8, w9) from ahead where w9 is not null),
        often as (select id, n, run from runs group by id, n, run having count(*) > 1),
        inside as (select distinct id, n, i + unnest(range(n)) as i from runs join often using (id, n, run)),
        run_sums as (
            select id, count(*) filter (n = 3) as n_repeat_words,
                sum(length(word)) filter (n = 5) as c5, sum(length(word)) filter (n = 6) as c6, sum(length(word)) filter (n = 7) as c7,
                sum(length(word)) filter (n = 8) as c8, sum(length(word)) filter (n = 9) as c9, sum(length(word)) filter (n = 10) as c10
            from inside join each using (id, i) group by id),
        measured as (
            select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
                coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(dup_line_chars, 0)::bigint as dup_line_chars,
                coalesce(c5, 0)::bigint as run_chars_5, coalesce(c6, 0)::bigint as run_chars_6, coalesce(c7, 0)::bigint as run_chars_7,
                coalesce(c8, 0)::bigint as run_chars_8, coalesce(c9, 0)::bigint as run_chars_9, coalesce(c10, 0)::bigint as run_chars_10
            from sizes left join line_sums using (id) left join run_sums using (id))
        select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
            not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * dup_line_chars > 20 * word_chars
                or 100 * run_chars_5 > 30 * word_chars or 100 * run_chars_6 > 28 * word_chars or 100 * run_chars_7 > 26 * word_chars
                or 100 * run_chars_8 > 24 * word_chars or 100 * run_chars_9 > 22 * word_chars or 100 * run_chars_10 > 20 * word_chars) as kept
        from measured""",
    "op12_collocations": r"""
        with texts as (select row_number() over () as id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
        pieces as (
            select id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece,
                unnest(range(len(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')))) as k from texts),
        split as (select id, lang, k, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
        each as (select id, lang, k, unnest(w) as word, unnest(range(len(w))) as i from split),
        ahead as (
            select lang, word as w0, lead(word, 1) over e as w1, lead(word, 2) over e as w2, lead(word, 3) over e as w3
            from each window e as (partition by id, k order by i)),
        counted as (
            select lang, 1 as size, [w0] as w, count(*) as f from ahead group by lang, w0
            union all select lang, 2, [w0, w1], count(*) from ahead where w1 is not null group by lang, w0, w1
            union all select lang, 3, [w0, w1, w2], count(*) from ahead where w2 is not null group by lang, w0, w1, w2
            union all select lang, 4, [w0, w1, w2, w3], count(*) from ahead where w3 is not null group by lang, w0, w1, w2, w3),
        phrases as (select * from counted where f >= 30),
        cuts as (select *, unnest(range(1, size)) as k from phrases where size > 1),
        parts as (
            select c.lang, c.size, c.w, c.f as a, c.k, x.f as l, y.f as r, (2000000::hugeint * c.f) // (x.f + y.f) as score
            from cuts c join phrases x on x.lang = c.lang and x.w = c.w[1:c.k] join phrases y on y.lang = c.lang and y.w = c.w[c.k + 1:]),
        chosen as (select * from (select *, row_number() over (partition by lang, w order by score, k) as nth from parts) where nth = 1),
        held as (
            select distinct c.lang, c.w
            from chosen c join (select lang, f, size, w, unnest(range(1, size)) as s from phrases where size > 2) p
                on p.lang = c.lang and p.size > c.size and s + c.size - 1 <= p.size and p.w[s:s + c.size - 1] = c.w and 100 * p.f >= 80 * c.a),
        ranked as (
            select c.lang, array_to_string(c.w, ' ') as phrase, a, l, r, score,
                row_number() over (partition by c.lang order by score desc, a desc, array_to_string(c.w, ' ')) as rank
            from chosen c anti join held h on h.lang = c.lang and h.w = c.w),
        totals as (select lang, sum(f) as n from counted where size = 1 group by lang)
        select r.lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked r join totals t on t.lang = r.lang where rank <= 2000""",
}

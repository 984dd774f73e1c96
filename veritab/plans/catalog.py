"""Every query of the core with its SQL.

Doubles are rounded to 8 places on both sides, since engines sum in other orders;
lists come out as joined texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritab.functions import features as X
from veritab.functions import text as T
from veritab.functions.scores import log_loss
from veritab.operators import calibration, compare, digests, ingest, leaks, manifest, metrics, paired, resample, selection, splits, tokens, trees
from veritab.operators.parameters import parameter_report as parameters_of
from veritab.plans import blocks, inputs as I
from veritab.sources import files, scorer
from veritab.streaming import leaks as streaming_leaks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLACES = 8
RESAMPLES = 2_000
TEMPERATURES = [0.5, 0.67, 1.0, 1.5, 3.09]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


def r(expression: str, name: str) -> str:
    return f"round({expression}, {PLACES}) as {name}"


def joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


# Text and ids


@query(f"select doc_id, {I.NORM} as normalized from documents")
def normalize_text(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@query("select source_index, sha256('train' || chr(0) || source_index || chr(0) || label || chr(0) || text) as id from example")
def row_id(spark, sf_dir):
    return I.table(spark, sf_dir, "example").select("source_index", T.row_id("train", F.col("source_index"), F.col("label"), F.col("text")).alias("id"))


@query(f"select doc_id, sha256({I.NORM}) as content_id from documents")
def content_id(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", T.content_id(F.col("text")).alias("content_id"))


@query(
    f"""select source_index as row_key, 'blank_text' as rule from example where not {I.FILLED}
    union all select source_index, 'missing_label' from example where label is null
    union all select source_index, 'label_out_of_range' from example where label not between 0 and 3
    union all select source_index, 'missing_index' from example where source_index is null"""
)
def validate_rows(spark, sf_dir):
    return ingest.violations(I.table(spark, sf_dir, "example"))


@query(f"with {I.CORPUS} select row_id, content_id, label, source_index from corpus")
def ingest_rows(spark, sf_dir):
    return I.corpus(spark, sf_dir)


@query(f"with {I.CORPUS} select row_id, '{T.SYSTEM_PROMPT}' as system, 'Article:' || chr(10) || {I.NORM} || chr(10) || chr(10) || 'Topic code:' as user_content from corpus")
def inference_messages(spark, sf_dir):
    m = I.corpus(spark, sf_dir, texts=True).select("row_id", T.inference_messages(F.col("text")).alias("m"))
    return m.select("row_id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user_content"))


@query(
    f"""with {I.CORPUS} select row_id, 3::bigint as messages, 'Article:' || chr(10) || {I.NORM} || chr(10) || chr(10) || 'Topic code:' as user_content,
    substr('ABCD', label + 1, 1) as answer from corpus"""
)
def training_messages(spark, sf_dir):
    m = I.corpus(spark, sf_dir, texts=True).select("row_id", T.training_messages(F.col("text"), F.col("label")).alias("m"))
    return m.select("row_id", F.size("m").cast("bigint").alias("messages"), F.col("m")[1]["content"].alias("user_content"), F.col("m")[2]["content"].alias("answer"))


@query(
    f"""with {I.CORPUS} select row_id, '<|system|>' || chr(10) || '{T.SYSTEM_PROMPT}' || chr(10) || '<|user|>' || chr(10) || 'Article:' || chr(10) || {I.NORM}
    || chr(10) || chr(10) || 'Topic code:' || chr(10) || '<|assistant|>' || chr(10) as prompt from corpus"""
)
def chat_render(spark, sf_dir):
    return I.corpus(spark, sf_dir, texts=True).select("row_id", T.render_chat(T.inference_messages(F.col("text"))).alias("prompt"))


ANSWERS = (" A ", "`d`", "The answer is A", '"b"', "c\n", "", "'C'", "E")


@query(
    "with answers as (select source_index, ["
    + ", ".join("'" + a.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for a in ANSWERS)
    + f"""][source_index % {len(ANSWERS)} + 1] as answer from example where source_index is not null)
    select source_index, case upper(trim(trim(answer, ' ' || chr(10)), '"''`')) when 'A' then 0 when 'B' then 1 when 'C' then 2 when 'D' then 3 end as parsed from answers"""
)
def parse_code(spark, sf_dir):
    answer = F.get(F.array(*map(F.lit, ANSWERS)), (F.col("source_index") % len(ANSWERS)).cast("int"))
    return I.table(spark, sf_dir, "example").where("source_index is not null").select("source_index", T.parse_code(answer).alias("parsed"))


@query(f"with {I.CORPUS} select row_id, code, name from corpus join topic_class using (label)")
def prompt_join_classes(spark, sf_dir):
    classes = I.table(spark, sf_dir, "topic_class").select("label", "code", "name")
    return I.corpus(spark, sf_dir).join(classes, "label").select("row_id", "code", "name")


# Splits


@query(f"with {I.development_sql()} select row_id, content_id, label, source_index, split from members")
def dev_split(spark, sf_dir):
    return I.development(spark, sf_dir)


@query(f"with {I.development_sql(I.EXPANDED)} select row_id, content_id, label, source_index, split from members")
def dev_split_expanded(spark, sf_dir):
    return I.development(spark, sf_dir, I.EXPANDED)


@query(
    f"""with {I.CORPUS}, every as (select unnest([0, 1, 2, 3]) as label)
    select label, count(row_id) as rows from every left join corpus using (label) group by label"""
)
def class_counts(spark, sf_dir):
    return splits.class_counts(I.corpus(spark, sf_dir))


@query(f"with {I.development_sql()} select split, count(*) as rows, sha256(string_agg(row_id, chr(10) order by row_id)) as row_ids_sha256 from members group by split")
def split_digest(spark, sf_dir):
    return splits.split_digests(I.development(spark, sf_dir))


@query(
    f"""with {I.development_sql()} select split, count(*) filter (where label = 0) as n_0, count(*) filter (where label = 1) as n_1, count(*) filter (where label = 2) as n_2,
    count(*) filter (where label = 3) as n_3, count(*) as rows, sha256(string_agg(row_id, chr(10) order by row_id)) as row_ids_sha256,
    (select count(*) from corpus) - (select count(*) from members) as unused from members group by split"""
)
def describe_splits(spark, sf_dir):
    return splits.described(I.development(spark, sf_dir), I.corpus(spark, sf_dir))


@query(
    f"""with {I.development_sql()} select label, row_id, source_index from (
    select *, row_number() over (partition by label order by row_id) as k from members where split = 'train' and label < 3) where k = 1"""
)
def examples_first_per_class(spark, sf_dir):
    return splits.first_of_classes(I.development(spark, sf_dir)).select("label", "row_id", "source_index")


# Leaks


def _leak_sql(key: str, a: str, b: str) -> str:
    return f"select count(distinct {key}) from published where split = '{b}' and {key} in (select {key} from published where split = '{a}' and {key} is not null)"


@query(
    f"""with {I.PUBLISHED} select shared_rows, shared_contents, case when shared_rows > 0 then shared_rows else shared_contents end as leaks, judged_rows from (
    select ({_leak_sql('row_id', 'train', 'validation')}) as shared_rows, ({_leak_sql('content_id', 'train', 'validation')}) as shared_contents,
    (select count(*) from published where split = 'validation') as judged_rows)"""
)
def leak_rows(spark, sf_dir):
    rows = I.published(spark, sf_dir)
    return leaks.leak_report(rows.where("split = 'train'"), rows.where("split = 'validation'"))


@query(f"with {I.PUBLISHED} select distinct content_id from published where split = 'test' and content_id in (select content_id from published where split = 'train')")
def leak_content(spark, sf_dir):
    rows = I.published(spark, sf_dir)
    return leaks.shared_keys(rows.where("split = 'train'"), rows.where("split = 'test'"), "content_id")


@query(
    f"""with {I.PUBLISHED}, d as (select distinct split, content_id from published)
    select a.split as split_a, b.split as split_b, count(*) as shared from d a join d b on a.content_id = b.content_id and a.split < b.split group by all"""
)
def leak_matrix(spark, sf_dir):
    return leaks.leak_matrix(I.published(spark, sf_dir))


@query(
    f"""with {I.PUBLISHED} select doc_id from documents where {I.FILLED} and sha256({I.NORM}) in (select content_id from published where split = 'train')
    union all select source_index as doc_id from example where {I.FILLED} and sha256({I.NORM}) in (select content_id from published where split in ('validation', 'test'))"""
)
def streaming_leak(spark, sf_dir):
    rows = I.published(spark, sf_dir)
    documents = streaming_leaks.leaking(I.table(spark, sf_dir, "documents").select("doc_id", "text"), rows.where("split = 'train'"))
    records = streaming_leaks.leaking(I.table(spark, sf_dir, "example").select(F.col("source_index").alias("doc_id"), "text"), rows.where("split in ('validation', 'test')"))
    return documents.select("doc_id").unionAll(records.select("doc_id"))


# Tokens and features

WHOLE = f"""len(string_split(regexp_replace(regexp_replace('{T.SYSTEM_PROMPT} Article:' || chr(10) || {I.NORM} || chr(10) || chr(10) || 'Topic code:',
  '[{T.SPACE}]+', ' ', 'g'), '^ | $', '', 'g'), ' ')) + 2"""
LENGTHS = f"lengths as (select split, row_id, {WHOLE} as n_tokens from members)"


@query(f"with {I.CORPUS} select row_id, {WHOLE} as n_tokens from corpus")
def token_lengths(spark, sf_dir):
    return I.prompt_lengths(I.corpus(spark, sf_dir, texts=True).withColumn("split", F.lit("all"))).select("row_id", "n_tokens")


SUMMARY = """count(*) as rows, min(n_tokens) as minimum, median(n_tokens)::double as median,
  list_sort(list(n_tokens))[greatest(1, (95 * count(*) + 99) // 100)] as p95_nearest_rank, max(n_tokens) as maximum, count(*) filter (where n_tokens > 90) as rows_over"""


@query(
    f"""with {I.development_sql()}, {LENGTHS}, both_ as (select split, n_tokens from lengths union all select 'all rows', n_tokens from lengths)
    select split, {SUMMARY}, count(*) filter (where n_tokens > 90) = 0 as safe from both_ group by split"""
)
def token_audit(spark, sf_dir):
    return tokens.token_audit(I.prompt_lengths(I.development(spark, sf_dir, texts=True)), 90)


@query(
    """select source, list_sort(list(length(text)))[greatest(1, (95 * count(text) + 99) // 100)] as p95, list_sort(list(length(text)))[greatest(1, (25 * count(text) + 99) // 100)] as p25
    from example where text is not null group by source"""
)
def nearest_rank(spark, sf_dir):
    rows = I.table(spark, sf_dir, "example").where("text is not null").select(F.coalesce("source", F.lit("\0")).alias("source"), F.length("text").cast("bigint").alias("n"))
    both = tokens.nearest_rank(rows, ["source"], "n", 95, "p95").join(tokens.nearest_rank(rows, ["source"], "n", 25, "p25"), "source")
    return both.withColumn("source", F.nullif("source", F.lit("\0")))


@query(
    f"""with {I.CORPUS}, v as (select row_id, regexp_replace(regexp_replace('<|system|>' || chr(10) || '{T.SYSTEM_PROMPT}' || chr(10) || '<|user|>' || chr(10) || 'Article:' || chr(10) || {I.NORM}
      || chr(10) || chr(10) || 'Topic code:' || chr(10) || '<|assistant|>' || chr(10), '[{T.SPACE}]+', ' ', 'g'), '^ | $', '', 'g') as prompt from corpus)
    select row_id, array_to_string(list_transform(string_split(prompt, ' '), lambda w: case when w in ('A', 'B', 'C', 'D') then 10 + ascii(w) - 65 else 20 + ('0x' || substr(sha256(w), 1, 4))::int end), ',') as ids from v"""
)
def prompt_token_ids(spark, sf_dir):
    ids = scorer.prompt_ids(scorer.HashTokenizer())
    return I.corpus(spark, sf_dir, texts=True).select("row_id", joined(ids(T.render_chat(T.inference_messages(F.col("text"))))).alias("ids"))


@query(
    """select config_id, seed, steps, greatest(1, round_even(0.03::double * steps, 0))::bigint as warmup from (
      select config_id, seed, (ceil(4 * train_per_class / 16.0::double) * 2)::bigint as steps from data_config)"""
)
def training_steps(spark, sf_dir):
    steps = selection.steps_of(4 * F.col("train_per_class"), 2, 8, 2)
    return I.table(spark, sf_dir, "data_config").select("config_id", "seed", steps.alias("steps"), selection.warmup_of(0.03, steps).alias("warmup"))


@query("select p_partkey, case when p_size > 1 and p_partkey > 0 then format('{:,}', p_partkey) || ' (' || printf('%.4f', 100.0::double * p_partkey / (p_partkey * p_size)) || '% of ' || format('{:,}', p_partkey * p_size) || ')' end as line from part")
def parameter_line(spark, sf_dir):
    """Trainable parameters as a report says them; null where the share contradicts the counts."""
    key, total = F.col("p_partkey"), F.col("p_partkey") * F.col("p_size")
    percent = F.when(F.col("p_size") > 1, F.lit(100.0) * key / total).otherwise(F.lit(50.0))
    return I.table(spark, sf_dir, "part").select("p_partkey", T.parameter_text(key, percent, total).alias("line"))


@query("select p_partkey, regexp_replace(round(pow(10.0::double, l - floor(l)), 11)::varchar, '\\.0$', '') || 'e' || floor(l)::bigint as text from (select p_partkey, p_partkey * -0.37::double as l from part)")
def scientific_text(spark, sf_dir):
    return I.table(spark, sf_dir, "part").select("p_partkey", T.scientific(F.col("p_partkey") * F.lit(-0.37)).alias("text"))


IDS = f"list_transform(string_split({I.NORM}, ' '), lambda w: 20 + ('0x' || substr(sha256(w), 1, 4))::int)"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.corpus(spark, sf_dir, texts=True)
    made = X.supervised(I.word_ids(F.col("text")), F.col("label") + 10, 2)
    return rows.select("row_id", "label", "source_index", made.alias("f")).select("row_id", "label", "source_index", "f.*")


@query(
    f"""with {I.CORPUS} select row_id, array_to_string({IDS} || [label + 10, 2], ',') as input_ids, array_to_string(list_transform({IDS}, lambda w: -100) || [label + 10, 2], ',') as labels,
    len({IDS}) + 2 as mask from corpus"""
)
def supervised_features(spark, sf_dir):
    mask = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return _features(spark, sf_dir).select("row_id", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("labels")).alias("labels"), mask.alias("mask"))


@query(f"with {I.CORPUS} select label, count(*) as rows, count(*) as audited from corpus group by label")
def feature_audit(spark, sf_dir):
    return _features(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(X.labelled(F.col("labels")) == 2).alias("audited"))


WIDTHS = f"with {I.CORPUS}, ids as (select row_id, source_index // 4 as batch, {IDS} as v from corpus), wide as (select *, max(len(v)) over (partition by batch) as w from ids)"


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.corpus(spark, sf_dir, texts=True).select("row_id", F.expr("source_index div 4").alias("batch"), I.word_ids(F.col("text")).alias("v"))
    return rows.withColumn("w", X.width_of(F.col("v"), ["batch"]))


@query(f"{WIDTHS} select row_id, array_to_string(list_transform(range(w - len(v)), lambda i: 2) || v, ',') as ids, w - len(v) as padding from wide")
def left_pad(spark, sf_dir):
    return _batches(spark, sf_dir).select("row_id", joined(X.padded_left(F.col("v"), F.col("w"), 2)).alias("ids"), (F.col("w") - F.size("v")).cast("bigint").alias("padding"))


@query(f"{WIDTHS} select row_id, array_to_string(v || list_transform(range(w - len(v)), lambda i: -100), ',') as ids, w as width from wide")
def right_pad(spark, sf_dir):
    return _batches(spark, sf_dir).select("row_id", joined(X.padded_right(F.col("v"), F.col("w"), -100)).alias("ids"), F.col("w").cast("bigint").alias("width"))


def _lse(at: int) -> str:
    return "ln(" + " + ".join(f"exp(8.0::double * embedding[{at + k}]::double)" for k in range(1, 5)) + ")"


@query(
    f"""select vec_id as pos, round((({_lse(0)} - 8.0::double * embedding[label % 4 + 1]::double) + ({_lse(4)} - 8.0::double * embedding[4 + (label + 1) % 4 + 1]::double)) / 2, {PLACES}) as loss from embeddings"""
)
def supervised_loss(spark, sf_dir):
    rows = I.table(spark, sf_dir, "embeddings")
    scores = F.array(*[F.transform(F.slice("embedding", 4 * i + 1, 4), lambda x: F.lit(8.0) * x.cast("double")) for i in range(3)])
    labels = F.array(F.lit(-100), (F.col("label") % 4).cast("int"), ((F.col("label") + 1) % 4).cast("int"))
    return rounded(rows.select(F.col("vec_id").cast("bigint").alias("pos"), X.reference_loss(scores, labels).alias("loss")), "loss")


# Scores and metrics


@query(f"with {I.logits_sql()} select pos, label, {', '.join(f'z[{k + 1}]::double as z{k}' for k in range(4))} from logits where system = 'tuned'")
def attached_labels(spark, sf_dir):
    """Scores and labels that match row for row."""
    rows = I.logits(spark, sf_dir).where("system = 'tuned'")
    both = blocks.attached(rows.select("pos", "z"), rows.select("pos", "label"))
    return both.select("pos", "label", *[F.col("z")[k].cast("double").alias(f"z{k}") for k in range(4)])


@query(f"with {I.logits_sql()}, {I.scores_sql()} select system, pos, {', '.join(r(f'p[{k + 1}]', f'p{k}') for k in range(4))} from scored")
def softmax(spark, sf_dir):
    rows = metrics.scored(I.logits(spark, sf_dir))
    return rows.select("system", "pos", *[F.round(F.col("p")[k], PLACES).alias(f"p{k}") for k in range(4)])


@query(f"with {I.logits_sql()}, {I.scores_sql()} select system, pos, label, pred::int as pred from scored")
def argmax_prediction(spark, sf_dir):
    return metrics.scored(I.logits(spark, sf_dir)).select("system", "pos", "label", "pred")


CELLS16 = "cells as (select a.k as label, b.k as pred from (select unnest([0,1,2,3]) as k) a, (select unnest([0,1,2,3]) as k) b)"


@query(
    f"""with {I.logits_sql()}, {I.scores_sql()}, {CELLS16}, every as (select s.system, label, pred from cells, (select distinct system from scored) s)
    select system, label, pred, count(pos) as rows from every left join scored using (system, label, pred) group by all"""
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(metrics.scored(I.logits(spark, sf_dir)), ["system"])


@query(f"with {I.LINES}, {CELLS16} select label, pred, count(lines.base) as rows from cells left join lines on lines.label = cells.label and lines.base = cells.pred group by all".replace("select label, pred", "select cells.label as label, cells.pred as pred"))
def confusion_matrix_lines(spark, sf_dir):
    return metrics.confusion(I.line_predictions(spark, sf_dir).withColumnRenamed("base", "pred"))


PER_CLASS = " union all ".join(
    f"""select {{by}}{k} as label, round(case when guess{k} > 0 then tp{k}::double / guess{k} else 0 end, {PLACES}) as precision, round(case when truth{k} > 0 then tp{k}::double / truth{k} else 0 end, {PLACES}) as recall,
    {r(I.f1_sql(k), 'f1')}, truth{k} as support from w"""
    for k in range(4)
)


@query(f"with {I.logits_sql()}, {I.scores_sql()}, w as ({I.cells_sql('scored', 'system')}) " + PER_CLASS.format(by="system, "))
def per_class_prf(spark, sf_dir):
    return rounded(metrics.per_class(metrics.scored(I.logits(spark, sf_dir)), ["system"]), "precision", "recall", "f1")


MAIN = f"rows, round(correct::double / rows, {PLACES}) as accuracy, {r(I.MACRO, 'macro_f1')}, round(invalid::double / rows, {PLACES}) as invalid_rate from w"


@query(f"with {I.logits_sql()}, {I.scores_sql()}, w as ({I.cells_sql('scored', 'system')}) select system, {MAIN}")
def accuracy_macro_f1(spark, sf_dir):
    return rounded(metrics.accuracy_macro_f1(metrics.scored(I.logits(spark, sf_dir)), ["system"]), "accuracy", "macro_f1", "invalid_rate")


@query(f"with {I.LINES}, v as (select label, case when l_partkey % 50 = 0 then 9 else base end as pred from lines), w as ({I.cells_sql('v')}) select {MAIN}")
def invalid_rate(spark, sf_dir):
    rows = I.line_predictions(spark, sf_dir, invalid=True).withColumnRenamed("base", "pred")
    return rounded(metrics.accuracy_macro_f1(rows), "accuracy", "macro_f1", "invalid_rate")


BINNED = f"""binned as (select system, {I.BIN} as bin, count(*) as rows, avg(confidence) as average_confidence, avg(correct::int) as accuracy from scored group by all),
  spine as (select system, unnest(range({I.BINS})) as bin from (select distinct system from scored)),
  bins as (select system, bin, coalesce(rows, 0) as rows, average_confidence, accuracy, average_confidence - accuracy as gap from spine left join binned using (system, bin))"""


@query(
    f"with {I.logits_sql()}, {I.scores_sql()}, {BINNED} select system, bin, round(({I.EDGES})[bin + 1], {PLACES}) as lower, round(({I.EDGES})[bin + 2], {PLACES}) as upper, rows, "
    + ", ".join(r(c, c) for c in ("average_confidence", "accuracy", "gap"))
    + " from bins"
)
def ece_bins(spark, sf_dir):
    bins = metrics.reliability(metrics.scored(I.logits(spark, sf_dir)), ["system"]).withColumn("bin", F.col("bin").cast("bigint"))
    return rounded(bins, "lower", "upper", "average_confidence", "accuracy", "gap")


@query(f"with {I.logits_sql()}, {I.scores_sql()}, {BINNED} select system, {r('sum(rows * abs(coalesce(gap, 0))) / sum(rows)', 'ece')} from bins group by system")
def ece(spark, sf_dir):
    return rounded(metrics.calibration_error(metrics.reliability(metrics.scored(I.logits(spark, sf_dir)), ["system"]), ["system"]), "ece")


@query(f"with {I.logits_sql()}, {I.scores_sql()} select system, {r('avg(loss)', 'nll')} from scored group by system")
def nll(spark, sf_dir):
    return rounded(I.logits(spark, sf_dir).groupBy("system").agg(F.avg(log_loss(F.col("z"), F.col("label"))).alias("nll")), "nll")


@query(" union all ".join(f"(with {I.logits_sql()}, {I.scores_sql(t)} select system, {t}::double as temperature, {r('avg(loss)', 'nll')} from scored group by system)" for t in TEMPERATURES))
def nll_curve(spark, sf_dir):
    return rounded(calibration.nll_curve(I.logits(spark, sf_dir), TEMPERATURES, ["system"]), "nll")


PHI = repr(calibration.INVERSE_PHI)


def _fit_sql(system: str) -> str:
    def loss(t: str) -> str:
        return f"list_sum(list_transform(v, lambda e: least(-ln(1e-12), greatest(0.0, ln(list_sum(list_transform(e.z, lambda x: exp(((x::double / (({t})::float)::double)::float)::double - ((e.z[e.y + 1]::double / (({t})::float)::double)::float)::double))))))))"

    return f"""select '{system}' as system, round((lo + hi) / 2, {PLACES}) as temperature from (
      with recursive {I.logits_sql()}, one as (select list({{'y': label, 'z': z}} order by pos) as v from logits where system = '{system}'),
      f(i, lo, hi) as (
        select 0, 0.05::double, 10.0::double
        union all
        select i + 1, case when below then lo else c end, case when below then d else hi end from (
          select *, {loss('c')} < {loss('d')} as below from (
            select i, lo, hi, hi - {PHI}::double * (hi - lo) as c, lo + {PHI}::double * (hi - lo) as d, v from f, one where hi - lo > 1e-4)))
      select lo, hi from f order by i desc limit 1)"""


@query(" union all ".join(_fit_sql(s) for s in I.SYSTEMS))
def temperature_fit(spark, sf_dir):
    fitted = calibration.fit_temperatures(I.logits(spark, sf_dir), "system")
    return rounded(spark.createDataFrame(sorted(fitted.items()), "system string, temperature double"), "temperature")


BLOCK = f"""w as ({I.cells_sql('scored', 'system')}), l as (select system, avg(loss) as nll from scored group by system),
  c as (select system, sum(rows * abs(coalesce(gap, 0))) / sum(rows) as ece from bins group by system)"""


def _block_sql(temperature: float) -> str:
    return f"""(with {I.logits_sql()}, {I.scores_sql(temperature)}, {BINNED}, {BLOCK} select system, rows, round(correct::double / rows, {PLACES}) as accuracy, {r(I.MACRO, 'macro_f1')},
    round(invalid::double / rows, {PLACES}) as invalid_rate, {r('nll', 'nll')}, {r('ece', 'ece')}, {temperature}::double as temperature from w join l using (system) join c using (system))"""


@query(f"{_block_sql(1.0)} union all {_block_sql(2.5)}")
def evaluation_block(spark, sf_dir):
    rows = I.logits(spark, sf_dir)
    blocks = [metrics.evaluation_block(rows, ["system"], t).withColumn("temperature", F.lit(t)) for t in (1.0, 2.5)]
    return rounded(blocks[0].unionByName(blocks[1]), "accuracy", "macro_f1", "invalid_rate", "nll", "ece")


@query(
    f"""with {I.logits_sql()}, {I.scores_sql(2.5)}, {BINNED}, {BLOCK}, m as (select system, {I.MACRO} as macro_f1, correct::double / rows as accuracy, ece from w join c using (system))
    select {', '.join(r(f"max({x}) filter (where system = 'tuned') - max({x}) filter (where system = 'base')", x) for x in ('macro_f1', 'accuracy', 'ece'))} from m"""
)
def calibration_delta(spark, sf_dir):
    return rounded(paired.system_delta(metrics.evaluation_block(I.logits(spark, sf_dir), ["system"], 2.5)), "macro_f1", "accuracy", "ece")


# Two systems


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.pair_systems(metrics.scored(I.logits(spark, sf_dir)).select("system", "pos", "label", "pred"))


PAIRS = f"""{I.logits_sql()}, {I.scores_sql()}, pairs as (select pos, any_value(label) as label, max(pred) filter (where system = 'base') as base,
  max(pred) filter (where system = 'tuned') as tuned from scored group by pos)"""
COUNTS = """count(*) as rows, count(*) filter (where base <> tuned) as disagreements, count(*) filter (where base <> label and tuned = label) as fixed,
  count(*) filter (where base = label and tuned <> label) as broken, count(*) filter (where base = label and tuned = label) as both_right,
  count(*) filter (where base <> label and tuned <> label) as both_wrong"""


@query(f"with {PAIRS} select pos, label, base::int as base, tuned::int as tuned from pairs")
def pair_systems(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"with {PAIRS}, {I.LINES} select 'scores' as source, {COUNTS} from pairs union all select 'lines', {COUNTS} from lines")
def paired_counts(spark, sf_dir):
    both = [paired.paired_counts(df).select(F.lit(name).alias("source"), "*") for name, df in (("scores", _pairs(spark, sf_dir)), ("lines", I.line_predictions(spark, sf_dir)))]
    return both[0].unionByName(both[1])


@query(
    f"""with {PAIRS}, k as (select {COUNTS} from pairs), b as (select fixed, broken, fixed + broken as n, least(fixed, broken) as m from k),
    t as (select n, m, fixed, broken, list_transform(range(m + 1), lambda i: lgamma(n + 1) - (case when i = 0 then 0 else lgamma(i + 1) end) - (case when i = n then 0 else lgamma(n - i + 1) end) - n * ln(2)) as terms from b),
    s as (select *, list_max(terms) + ln(list_sum(list_transform(terms, lambda x: exp(x - list_max(terms))))) + ln(2) as tail from t)
    select n as discordant, round((abs(fixed - broken) - 1) ** 2 / n, 6) as chi_square, round(least(0.0, tail / ln(10)), 6) as log10_p, round(exp(least(0.0, tail)), 8) as p,
      floor(least(0.0, tail / ln(10)))::bigint as exponent from s"""
)
def mcnemar(spark, sf_dir):
    out = paired.mcnemar(paired.paired_counts(_pairs(spark, sf_dir)))
    exponent = F.split("p_text", "e")[1].cast("bigint")
    return out.select("discordant", F.round("chi_square", 6).alias("chi_square"), F.round("log10_p", 6).alias("log10_p"), F.round("p", 8).alias("p"), exponent.alias("exponent"))


@query("select (l_linenumber % 4)::bigint as grp, count(*) filter (where l_partkey % 10 >= 7 and l_suppkey % 20 < 18) + count(*) filter (where l_partkey % 10 < 7 and l_suppkey % 20 >= 18) as discordant from lineitem group by 1")
def mcnemar_lines(spark, sf_dir):
    counts = paired.paired_counts(I.line_predictions(spark, sf_dir).withColumn("grp", F.col("label").cast("bigint")), ["grp"])
    return paired.mcnemar(counts, ["grp"]).select("grp", "discordant")


@query()
def mcnemar_groups(spark, sf_dir):
    """The whole test of each group whose discordant rows ``mcnemar_lines`` counts."""
    counts = paired.paired_counts(I.line_predictions(spark, sf_dir).withColumn("grp", F.col("label").cast("bigint")), ["grp"])
    return rounded(paired.mcnemar(counts, ["grp"]), "chi_square", "log10_p")


DRAWS = """draws as (select i // n as resample, i % n as j, ('0x' || substr(sha256('73' || chr(0) || (i // n) || chr(0) || (i % n)), 1, 15))::bigint % n as drawn
  from (select unnest(range({count} * n)) as i, n from (select count(*) as n from embeddings)))"""


@query(f"with {DRAWS.format(count=20)} select resample, j, drawn from draws")
def bootstrap_draws(spark, sf_dir):
    return resample.hash_draws(spark, I.table(spark, sf_dir, "embeddings").count(), 20)


def _resamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return resample.hash_resamples(pairs.withColumnRenamed("pos", "j"), I.table(spark, sf_dir, "embeddings").count(), RESAMPLES)


def _macro_sql(pred: str) -> str:
    each = " + ".join(f"(case when count(*) filter (where label = {k}) + count(*) filter (where {pred} = {k}) > 0 then 2.0::double * count(*) filter (where label = {k} and {pred} = {k}) / (count(*) filter (where label = {k}) + count(*) filter (where {pred} = {k})) else 0 end)" for k in range(4))
    return f"({each}) / 4.0"


@query(
    f"""with {PAIRS}, {DRAWS.format(count=RESAMPLES)}, f as (select resample, {_macro_sql('base')} as base, {_macro_sql('tuned')} as tuned from draws join pairs on drawn = pos group by resample),
    v as (select 'base' as system, base as x from f union all select 'tuned', tuned from f union all select 'delta', tuned - base from f)
    select system, {r('quantile_cont(x, 0.025)', 'ci_lower')}, {r('quantile_cont(x, 0.975)', 'ci_upper')}, {r('quantile_cont(x, 0.975) - quantile_cont(x, 0.025)', 'ci_width')},
    case when system = 'delta' then count(*) filter (where x <= 0) end as no_improvement from v group by system"""
)
def bootstrap_ci(spark, sf_dir):
    return rounded(resample.summary(_resamples(spark, sf_dir)), "ci_lower", "ci_upper", "ci_width")


@query()
def bootstrap_cells(spark, sf_dir):
    counts = resample.cell_counts(I.line_predictions(spark, sf_dir))
    return rounded(resample.summary(spark.createDataFrame(resample.cell_resamples(counts))), "ci_lower", "ci_upper", "ci_width")


@query()
def bootstrap_exact(spark, sf_dir):
    return rounded(resample.summary(resample.exact_resamples(_pairs(spark, sf_dir))), "ci_lower", "ci_upper", "ci_width")


@query(
    f"""with {I.logits_sql(I.EPOCHS, 'epoch')}, {I.scores_sql()}, w as ({I.cells_sql('scored', 'epoch')}), m as (select epoch, {I.MACRO} as macro_f1 from w)
    select epoch, {r('macro_f1', 'macro_f1')} from m order by m.macro_f1 desc, epoch limit 1"""
)
def checkpoint_select(spark, sf_dir):
    rows = metrics.accuracy_macro_f1(metrics.scored(I.logits(spark, sf_dir, I.EPOCHS, "epoch")), ["epoch"])
    return rounded(selection.select_checkpoint(rows.select("epoch", "macro_f1")), "macro_f1")


@query(
    f"""with {I.logits_sql()}, {I.scores_sql()}, w as ({I.cells_sql('scored', 'system')}), m as (select {I.MACRO} as macro_f1 from w where system = 'base')
    select {r('expected', 'expected')}, {r('macro_f1', 'actual')}, {r('abs(expected - macro_f1)', 'absolute_difference')}, abs(expected - macro_f1) <= 0.005 as agrees from m, (select unnest([0.45::double, 0.7::double, 0.9::double]) as expected)"""
)
def baseline_agreement(spark, sf_dir):
    base = metrics.accuracy_macro_f1(metrics.scored(I.logits(spark, sf_dir).where("system = 'base'")), [])
    values = base.select(F.explode(F.array(F.lit(0.45), F.lit(0.7), F.lit(0.9))).alias("expected"), F.col("macro_f1").alias("actual"))
    return rounded(selection.baseline_agreement(values), "expected", "actual", "absolute_difference")


# Digests, trees, manifests


@query(f"with {I.logits_sql()} select system, sha256(string_agg(label::varchar, ',' order by pos)) as label_sha256 from logits group by system")
def label_digest(spark, sf_dir):
    return digests.label_digest(I.logits(spark, sf_dir), ["system"])


@query(f"with {I.logits_sql()}, {I.scores_sql()} select system, sha256(string_agg(pred::varchar, ',' order by pos)) as prediction_sha256 from scored group by system")
def prediction_digest(spark, sf_dir):
    return digests.label_digest(metrics.scored(I.logits(spark, sf_dir)), ["system"], "pred", name="prediction_sha256")


@query(
    f"""with {I.development_sql()}, {LENGTHS} select split, sha256('[' || string_agg('{{"prompt_plus_answer_tokens":' || n_tokens || ',"row_id":"' || row_id || '"}}', ',' order by row_id) || ']') as token_lengths_sha256
    from lengths group by split"""
)
def canonical_json_digest(spark, sf_dir):
    return digests.lengths_digest(I.prompt_lengths(I.development(spark, sf_dir, texts=True)), ["split"])


@query()
def array_digest(spark, sf_dir):
    return digests.array_digest(I.logits(spark, sf_dir), ["system"])


def _tree(moved: str = "0", named: str = "true", added: str = "''") -> str:
    """A JSON text with objects in objects, a list, a null, an empty object and one value of each kind; the same in both engines."""
    return f"""concat('{{"id": ', event_id, ', "p": ', coalesce(props, 'null'), ', "l": [1, ', event_id % 5 + {moved}, '], "b": ', case when event_id % 2 = 0 then 'true' else 'false' end, ', "n": null, "e": {{}}',
      case when {named} then concat(', "s": "x', event_id % 3, '"') else '' end, ', "d": {{"in": {{"f": ', event_id % 8, '.5}}}}', {added}, '}}')"""


CHANGED = ("case when event_id % 7 = 0 then 1 else 0 end", "event_id % 11 <> 0", "case when event_id % 13 = 0 then ', \"z\": 1' else '' end")
LEAVES = """unnest([{{'path': 'id', 'kind': 'int', 'value': event_id::varchar}}, {{'path': case when props is null then 'p' else 'p.k' end, 'kind': case when props is null then 'null' else 'int' end, 'value': regexp_extract(props, '-?[0-9]+')}},
    {{'path': 'l', 'kind': 'list', 'value': '[1,' || (event_id % 5)::varchar || ']'}}, {{'path': 'b', 'kind': 'bool', 'value': (event_id % 2 = 0)::varchar}}, {{'path': 'n', 'kind': 'null', 'value': null}},
    {{'path': 's', 'kind': 'text', 'value': '"x' || (event_id % 3)::varchar || '"'}}, {{'path': 'd.in.f', 'kind': 'float', 'value': (event_id % 8)::varchar || '.5'}}])"""


@query(f"select event_id, x.path as path, x.kind as kind, x.value as value from (select event_id, {LEAVES.format()} as x from events)")
def flatten_json(spark, sf_dir):
    texts = I.table(spark, sf_dir, "events").select("event_id", F.expr(_tree()).alias("tree"))
    return trees.flatten_json(texts, "event_id", "tree")


@query(
    """select event_id, 'l' as path, '[1,' || (event_id % 5)::varchar || ']' as left_value, '[1,' || (event_id % 5 + 1)::varchar || ']' as right_value, 'different' as reason from events where event_id % 7 = 0
    union all select event_id, 's', '"x' || (event_id % 3)::varchar || '"', null, 'missing' from events where event_id % 11 = 0
    union all select event_id, 'z', null, '1', 'unexpected' from events where event_id % 13 = 0"""
)
def tree_diff(spark, sf_dir):
    events = I.table(spark, sf_dir, "events")
    left, right = (trees.flatten_json(events.select("event_id", F.expr(t).alias("tree")), "event_id", "tree") for t in (_tree(), _tree(*CHANGED)))
    return trees.tree_diff(left, right, ["event_id"])


def _prices(spark: SparkSession, sf_dir: str, gap: Column) -> list[DataFrame]:
    """Leaf tables of order prices and, on the other side, prices moved by a gap."""
    price = F.col("o_totalprice").cast("double")
    rows = I.table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"))
    return [rows.select("o_orderkey", F.lit("price").alias("path"), F.lit("float").alias("kind"), v.cast("string").alias("value")) for v in (F.col("price"), gap)]


def _gap(step: float) -> Column:
    return F.element_at(F.array(*[F.lit(g * step) for g in (0.0, 5e-10, 2e-9, 0.5)]), (F.col("o_orderkey") % 4 + 1).cast("int"))


@query("select o_orderkey, 'price' as path, 'different' as reason from orders where o_orderkey % 4 >= 2")
def tree_close_relative(spark, sf_dir):
    """Floats within a relative 1e-9 of each other are equal."""
    left, right = _prices(spark, sf_dir, F.col("price") * (1 + _gap(1.0)))
    return trees.tree_diff(left, right, ["o_orderkey"], relative=trees.TOLERANCE).select("o_orderkey", "path", "reason")


@query("select o_orderkey, 'price' as path, 'different' as reason from orders where o_orderkey % 4 >= 2")
def tree_close_absolute(spark, sf_dir):
    """Floats within an absolute 1e-9 of each other are equal; shares of the price are compared."""
    left, right = _prices(spark, sf_dir, F.col("price"))
    share = (F.col("value").cast("double") / 1e6)
    left, right = left.withColumn("value", share.cast("string")), right.withColumn("value", (share + _gap(1.0)).cast("string"))
    return trees.tree_diff(left, right, ["o_orderkey"], absolute=trees.TOLERANCE).select("o_orderkey", "path", "reason")


@query(
    """select d.revision as revision, a.path as path, a.v as left_value, b.v as right_value from (
      select dataset_revision as revision, min(config_id) as a, max(config_id) as b from data_config where dataset_revision is not null group by all having min(config_id) < max(config_id)) d,
      lateral (select 'seed' as path union all select 'train_per_class' union all select 'validation_per_class' union all select 'validation_start_per_class') p,
      lateral (select p.path as path, case p.path when 'seed' then max(seed)::varchar when 'train_per_class' then max(train_per_class)::varchar when 'validation_per_class' then max(validation_per_class)::varchar else max(validation_start_per_class)::varchar end as v from data_config where config_id = d.a) a,
      lateral (select case p.path when 'seed' then max(seed)::varchar when 'train_per_class' then max(train_per_class)::varchar when 'validation_per_class' then max(validation_per_class)::varchar else max(validation_start_per_class)::varchar end as v from data_config where config_id = d.b) b
    where a.v is distinct from b.v"""
)
def config_diff(spark, sf_dir):
    names = ("seed", "train_per_class", "validation_per_class", "validation_start_per_class")
    rows = I.table(spark, sf_dir, "data_config").where("dataset_revision is not null").groupBy("config_id", F.col("dataset_revision").alias("revision")).agg(*[F.max(n).alias(n) for n in names])
    ends = rows.groupBy("revision").agg(F.min("config_id").alias("a"), F.max("config_id").alias("b")).where("a < b")
    leaf = F.explode(F.array(*[F.struct(F.lit(n).alias("path"), F.col(n).cast("string").alias("value")) for n in names]))
    flat = rows.select("config_id", "revision", leaf.alias("x")).select("config_id", "revision", "x.*").where("value is not null").withColumn("kind", F.lit("int"))
    sides = [flat.join(ends.select("revision", F.col(s).alias("config_id")), ["revision", "config_id"]).drop("config_id") for s in "ab"]
    return trees.tree_diff(*sides, ["revision"]).select("revision", "path", "left_value", "right_value")


RUN_PAIRS = """c as (select config_id, dataset_revision as revision, max(seed) as seed, max(train_per_class) as train, max(validation_per_class) as validation, max(validation_start_per_class) as start,
    max(publisher_test_rows) as library, max(dataset_name) as gpu from data_config where dataset_revision is not null group by all),
  d as (select revision, min(config_id) as a, max(config_id) as b from c group by all having min(config_id) < max(config_id)),
  p as (select d.revision as revision, (l.library is distinct from r.library)::bigint as library_changes, (l.validation is distinct from r.validation)::bigint + (l.start is distinct from r.start)::bigint as unexpected_changes,
    2 - (l.seed is distinct from r.seed)::bigint - (l.train is distinct from r.train)::bigint as missing_changes, coalesce(l.gpu = r.gpu, false) as gpu_matches
    from d join c l on l.config_id = d.a and l.revision = d.revision join c r on r.config_id = d.b and r.revision = d.revision)"""


@query(
    f"""with {RUN_PAIRS} select revision, 0::bigint as host_changes, library_changes, unexpected_changes, missing_changes, gpu_matches, true as labels_match,
    library_changes = 0 and unexpected_changes = 0 and missing_changes = 0 and gpu_matches as controlled from p"""
)
def compare_runs(spark, sf_dir):
    """First and last config of each revision as runs: seed and train_per_class are meant to change."""
    leaves = {
        "config.seed": ("int", F.max("seed")), "config.train_per_class": ("int", F.max("train_per_class")), "config.validation_per_class": ("int", F.max("validation_per_class")),
        "config.validation_start_per_class": ("int", F.max("validation_start_per_class")), "environment.packages.publisher": ("int", F.max("publisher_test_rows")),
        compare.GPU: ("text", F.max("dataset_name")), compare.LABELS: ("text", F.max("dataset_revision")),
    }
    rows = I.table(spark, sf_dir, "data_config").where("dataset_revision is not null").groupBy("config_id", F.col("dataset_revision").alias("revision"))
    rows = rows.agg(*[v.cast("string").alias(f"l{k}") for k, (_, v) in enumerate(leaves.values())])
    each = [F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), F.col(f"l{k}").alias("value")) for k, (path, (kind, _)) in enumerate(leaves.items())]
    flat = rows.select("config_id", "revision", F.explode(F.array(*each)).alias("x")).select("config_id", "revision", "x.*").where("value is not null")
    ends = rows.groupBy("revision").agg(F.min("config_id").alias("a"), F.max("config_id").alias("b")).where("a < b")
    sides = [flat.join(ends.select("revision", F.col(s).alias("config_id")), ["revision", "config_id"]).drop("config_id") for s in "ab"]
    return compare.run_flags(*sides, ["revision"], ["seed", "train_per_class"])


@query()
def manifest_scan(spark, sf_dir):
    return files.scan(spark, sf_dir)


@query()
def manifest_combined(spark, sf_dir):
    return manifest.combined(files.scan(spark, sf_dir))


@query()
def manifest_verify(spark, sf_dir):
    now = files.scan(spark, sf_dir)
    changed = F.when(F.col("path").startswith("nation"), F.lit("0")).otherwise(F.col("sha256"))
    return manifest.manifest_diff(now.withColumn("sha256", changed).where(~F.col("path").startswith("region")), now, ("part.parquet",))


@query(
    """with t as (select p_size * 1000 as numel, p_partkey % 50 = 0 as g, p_partkey % 3 = 1 and p_partkey % 50 <> 0 as q, 1 + p_partkey % 2 as e from part),
    c as (select *, case when q then numel * 2 * e else numel end as n from t)
    select sum(n)::bigint as total, sum(n) filter (where g)::bigint as trainable, round(100.0::double * sum(n) filter (where g) / sum(n), 8) as trainable_percent, sum(numel)::bigint as stored from c"""
)
def parameter_report(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.concat(F.lit("layer."), key.cast("string"), F.when(key % 50 == 0, F.lit(".lora_A")).otherwise(F.lit("")))
    rows = I.table(spark, sf_dir, "part").select(
        name.alias("name"), (F.col("p_size") * 1000).cast("bigint").alias("numel"), (key % 50 == 0).alias("requires_grad"), ((key % 3 == 1) & (key % 50 != 0)).alias("is_4bit"), (1 + key % 2).cast("int").alias("element_size")
    )
    return rounded(parameters_of(rows), "trainable_percent")


@query()
def environment(spark, sf_dir):
    return files.environment_table(spark)

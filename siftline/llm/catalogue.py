"""Queries p3, p5, p7, p8, p9 and p10: operators on text corpora over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.keys import sql_key, sql_squeezed
from siftline.llm import consensus, encoding, history_dedup, language, matching, mixing
from siftline.runtime import spread, work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch rows that report a finding which is known already."""
    return history_dedup.repeated_items(table(spark, sf_dir, "issues"), table(spark, sf_dir, "issue_batches"), work_dir(spark, "history"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of every finding key with verdicts of at least three labelers."""
    return p5_items(spark, sf_dir).where("labels >= 3").select("finding_key", "kind")


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus, confidence and agreement per finding key."""
    fitted = consensus.Consensus(table(spark, sf_dir, "feedback_entries"), work_dir(spark, "consensus"))
    return fitted.items().withColumnRenamed("item", "finding_key")


def p5_labelers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability and guesses per labeler."""
    return consensus.Consensus(table(spark, sf_dir, "feedback_entries"), work_dir(spark, "consensus")).annotators()


def p5_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labeler's latest verdict on each key."""
    labels = consensus.latest_labels(table(spark, sf_dir, "feedback_entries"))
    kind = F.get(F.array(*[F.lit(x) for x in consensus.LABELS]), F.col("label"))
    return labels.select(F.col("item").alias("finding_key"), F.col("annotator").alias("labeler"), kind.alias("kind"))


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch rows found to repeat a finding that were delivered before in equal form."""
    issues, batches = table(spark, sf_dir, "issues"), table(spark, sf_dir, "issue_batches")
    form = ["rule_id", "file", "line", "message"]
    digest = F.md5(F.to_json(F.struct(*form)))
    known = issues.select(digest.alias("d")).distinct()
    rows = batches.select("item_id", digest.alias("d"))
    first = rows.groupBy("d").agg(F.min("item_id").alias("first"))
    equal = rows.join(first, "d").join(known.withColumn("old", F.lit(True)), "d", "left").where("old or item_id > first").select("item_id").distinct()
    return p3_found(spark, sf_dir).join(equal, "item_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the pattern scanner and findings of the tree analyser about the same defect."""
    return p7_confidence(spark, sf_dir).select("hit_id", "ast_id")


def p7_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with their confidence."""
    left = matching.parts(table(spark, sf_dir, "yaml_hits"), "hit_id", "message")
    right = matching.parts(table(spark, sf_dir, "ast_findings"), "ast_id", "description")
    found = matching.matches(left, right, work_dir(spark, "matching"))
    return found.withColumnsRenamed({"left_id": "hit_id", "right_id": "ast_id"})


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by the public 50k byte-level vocabulary."""
    return encoding.encode_corpus(texts(spark, sf_dir))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what the ids of every document decode to."""
    return encoding.decoded_digests(encoding.encode_corpus(texts(spark, sf_dir)))


def p9_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable distinct texts per source with a target."""
    units = mixing.units(texts(spark, sf_dir), table(spark, sf_dir, "mix_targets"), work_dir(spark, "mix"))
    return units.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("first_doc"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    units = mixing.units(texts(spark, sf_dir), targets, work_dir(spark, "mix"))
    return mixing.mixture(units, targets), units, targets


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by the mixture."""
    return mixing.shares(*_mix(spark, sf_dir))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return language.segments(docs, language.train(docs))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the documents whose label is missing, wrong or tells only part."""
    return language.mislabelled(language.found_languages(_languages(spark, sf_dir)))


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and confidence of every document."""
    return language.found_languages(_languages(spark, sf_dir)).drop("named").withColumn("langs", F.concat_ws(",", "langs"))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    parts = _languages(spark, sf_dir).select("doc_id", F.posexplode("segments").alias("segment_no", "s"))
    return parts.select("doc_id", "segment_no", "s.lang", "s.confidence", "s.sentences", "s.chars")


QUERIES = {f.__name__: f for f in (
    p3_found, p3_copies, p5_found, p5_items, p5_labelers, p5_latest, p7_found, p7_confidence, p8_ids, p8_roundtrip, p9_mix, p9_shares, p9_units, p10_found, p10_documents, p10_segments
)}

_KIND = sql_squeezed("kind")
SQL: dict[str, str] = {
    "p3_copies": """
with a as (select item_id, rule_id, file, line, message from issue_batches), k as (select distinct rule_id, file, line, message from issues)
select distinct a.item_id from a where exists (select 1 from k where k.rule_id is not distinct from a.rule_id and k.file is not distinct from a.file and k.line is not distinct from a.line and k.message is not distinct from a.message)
or exists (select 1 from a b where b.item_id < a.item_id and b.rule_id is not distinct from a.rule_id and b.file is not distinct from a.file and b.line is not distinct from a.line and b.message is not distinct from a.message)""",
    "p5_latest": f"""
with l as (
  select {sql_key('finding_key')} finding_key, {sql_key('labeler')} labeler, labeled_at, entry_id,
    case when {_KIND} in ('tp', 'truepositive') then 'tp' when {_KIND} in ('fp', 'falsepositive') then 'fp' when {_KIND} in ('fn', 'falsenegative') then 'fn' end kind from feedback_entries
), o as (select * from l where finding_key is not null and labeler is not null and kind is not null)
select finding_key, labeler, kind from o qualify row_number() over (partition by finding_key, labeler order by labeled_at desc nulls last, entry_id desc, case kind when 'tp' then 0 when 'fp' then 1 else 2 end desc) = 1""",
    "p8_roundtrip": "select doc_id, sha256(coalesce(text, '')) digest from documents",
    "p9_units": "select source, count(distinct text) texts, min(doc_id) first_doc from documents where text is not null and text <> '' and source in (select source from mix_targets) group by 1",
}

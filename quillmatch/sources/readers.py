"""Readers: registry JSON and XML studies, topics, judgements, thesaurus, banks, predictions.

Every reader names its schema, so nothing is inferred and unknown fields are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions import text as T

LOCATIONS, CONTACTS = 50, 5

_JSON = """protocolSection struct<
  identificationModule: struct<nctId:string,briefTitle:string,officialTitle:string>,
  descriptionModule: struct<briefSummary:string,detailedDescription:string>,
  conditionsModule: struct<conditions:array<string>,keywords:array<string>>,
  armsInterventionsModule: struct<interventions:array<struct<name:string>>>,
  designModule: struct<phases:array<string>,studyType:string,enrollmentInfo:struct<count:int>>,
  statusModule: struct<overallStatus:string,lastUpdatePostDateStruct:struct<date:string>>,
  eligibilityModule: struct<eligibilityCriteria:string,minimumAge:string,maximumAge:string,sex:string,healthyVolunteers:string>,
  contactsLocationsModule: struct<locations:array<struct<facility:string,city:string,state:string,country:string,status:string>>,
    centralContacts:array<struct<name:string,role:string,email:string,phone:string>>>,
  sponsorCollaboratorsModule: struct<leadSponsor:struct<name:string>>>"""


def _eligibility(raw: Column, low: Column, high: Column, sex: Column, healthy: Column) -> Column:
    parts = T.split_eligibility(raw)
    return F.struct(
        F.coalesce(raw, F.lit("")).alias("raw_text"),
        parts["inclusion"].alias("inclusion_text"),
        parts["exclusion"].alias("exclusion_text"),
        F.struct(
            T.age_days(low).alias("min_days"), T.age_days(high).alias("max_days"), low.alias("raw_min"), high.alias("raw_max")
        ).alias("age_range"),
        T.sex(sex).alias("sex"),
        T.yes_no(healthy).alias("accepts_healthy_volunteers"),
    )


def _texts(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def studies_json(spark: SparkSession, path: str) -> DataFrame:
    """Trials from files that each hold an array of studies; broken files and studies without id are left out."""
    raw = spark.read.schema(_JSON).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return trials_of_sections(raw.select("protocolSection.*"))


def trials_of_sections(p: DataFrame, carry: tuple = ()) -> DataFrame:
    """Trials from the modules of a study's protocol section, with the columns ``carry`` in front."""
    c = F.col
    return p.where(F.coalesce("identificationModule.nctId", F.lit("")) != "").select(
        *carry,
        c("identificationModule.nctId").alias("nct_id"),
        F.coalesce("identificationModule.briefTitle", F.lit("")).alias("title"),
        c("identificationModule.officialTitle").alias("official_title"),
        F.coalesce("descriptionModule.briefSummary", F.lit("")).alias("brief_summary"),
        c("descriptionModule.detailedDescription").alias("detailed_description"),
        _texts(c("conditionsModule.conditions")).alias("conditions"),
        _texts(c("conditionsModule.keywords")).alias("keywords"),
        _texts(c("armsInterventionsModule.interventions.name")).alias("interventions"),
        T.phase_json(F.get("designModule.phases", F.lit(0))).alias("phase"),
        T.status(c("statusModule.overallStatus")).alias("status"),
        c("designModule.studyType").alias("study_type"),
        (F.upper("designModule.studyType") == "INTERVENTIONAL").alias("interventional"),
        _eligibility(*[c(f"eligibilityModule.{f}") for f in ("eligibilityCriteria", "minimumAge", "maximumAge", "sex", "healthyVolunteers")]).alias("eligibility"),
        F.slice(F.coalesce("contactsLocationsModule.locations", F.array()), 1, LOCATIONS).alias("locations"),
        F.slice(F.coalesce("contactsLocationsModule.centralContacts", F.array()), 1, CONTACTS).alias("contacts"),
        c("sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"),
        T.any_date(c("statusModule.lastUpdatePostDateStruct.date")).alias("last_update_date"),
        c("designModule.enrollmentInfo.count").alias("enrollment"),
    )


_XML = """id_info struct<nct_id:string>, brief_title string, official_title string,
  brief_summary struct<textblock:string>, detailed_description struct<textblock:string>,
  condition array<string>, keyword array<string>,
  condition_browse struct<mesh_term:array<string>>, intervention_browse struct<mesh_term:array<string>>,
  intervention array<struct<intervention_name:string>>, phase string, overall_status string, study_type string,
  eligibility struct<criteria:struct<textblock:string>,gender:string,minimum_age:string,maximum_age:string,healthy_volunteers:string>,
  location array<struct<facility:struct<name:string,address:struct<city:string,state:string,country:string>>,status:string>>,
  overall_contact array<struct<last_name:string,role:string,email:string,phone:string>>,
  sponsors struct<lead_sponsor:struct<agency:string>>, last_update_posted string, enrollment string"""


def raw_xml(spark: SparkSession, path: str | list[str], schema: str = _XML) -> DataFrame:
    """The fields of ``schema`` of every study element; malformed files give no row."""
    return spark.read.format("xml").schema(schema).option("rowTag", "clinical_study").option("mode", "DROPMALFORMED").load(path)


def studies_xml(spark: SparkSession, path: str) -> DataFrame:
    """Trials from legacy XML; white space is collapsed everywhere, malformed files give no row."""
    return trials_of_xml(raw_xml(spark, path))


def trials_of_xml(raw: DataFrame, carry: tuple = ()) -> DataFrame:
    """Trials from the fields of legacy XML, with the columns ``carry`` in front."""
    c, flat = F.col, lambda x: T.collapse(F.col(x))
    many = lambda x: F.transform(_texts(F.col(x)), T.collapse)
    place = lambda l: F.struct(
        l["facility"]["name"].alias("facility"),
        l["facility"]["address"]["city"].alias("city"),
        l["facility"]["address"]["state"].alias("state"),
        l["facility"]["address"]["country"].alias("country"),
        l["status"].alias("status"),
    )
    contact = lambda k: F.struct(k["last_name"].alias("name"), k["role"].alias("role"), k["email"].alias("email"), k["phone"].alias("phone"))
    return raw.where(F.coalesce("id_info.nct_id", F.lit("")) != "").select(
        *carry,
        flat("id_info.nct_id").alias("nct_id"),
        F.coalesce(flat("brief_title"), F.lit("")).alias("title"),
        flat("official_title").alias("official_title"),
        F.coalesce(flat("brief_summary.textblock"), F.lit("")).alias("brief_summary"),
        flat("detailed_description.textblock").alias("detailed_description"),
        many("condition").alias("conditions"),
        F.concat(many("keyword"), many("condition_browse.mesh_term"), many("intervention_browse.mesh_term")).alias("keywords"),
        F.transform(_texts(c("intervention.intervention_name")), T.collapse).alias("interventions"),
        T.phase_xml(c("phase")).alias("phase"),
        T.status(c("overall_status")).alias("status"),
        flat("study_type").alias("study_type"),
        (F.upper("study_type") == "INTERVENTIONAL").alias("interventional"),
        _eligibility(flat("eligibility.criteria.textblock"), *[c(f"eligibility.{f}") for f in ("minimum_age", "maximum_age", "gender", "healthy_volunteers")]).alias("eligibility"),
        F.slice(F.transform(F.coalesce("location", F.array()), place), 1, LOCATIONS).alias("locations"),
        F.slice(F.transform(F.coalesce("overall_contact", F.array()), contact), 1, CONTACTS).alias("contacts"),
        flat("sponsors.lead_sponsor.agency").alias("sponsor"),
        F.coalesce(F.try_to_date(c("last_update_posted"), "MMMM d, yyyy"), T.any_date(c("last_update_posted"))).alias("last_update_date"),
        F.regexp_extract("enrollment", r"(\d+)", 1).try_cast("int").alias("enrollment"),
    )


def topics_xml(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, text) of every topic element with a number or id and some text."""
    schema = "_number string, _id string, _VALUE string"
    raw = spark.read.format("xml").schema(schema).option("rowTag", "topic").load(path)
    rows = raw.select(F.coalesce("_number", "_id").alias("topic_id"), F.regexp_replace("_VALUE", r"^\s+|\s+$", "").alias("text"))
    return rows.where("topic_id is not null and text <> ''")


def topics_json(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, text) of an object or array with topic_id or patient_id and text or raw_text."""
    schema = "topic_id string, patient_id string, text string, raw_text string"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select(F.coalesce("topic_id", "patient_id").alias("topic_id"), F.coalesce("text", "raw_text").alias("text"))
    return rows.where("topic_id is not null and text is not null")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".xml"):
        return topics_xml(spark, path)
    if path.endswith(".json"):
        return topics_json(spark, path)
    raise ValueError("topics are read from .xml or .json files")


def pick_topics(topics: DataFrame, ids: str | None = None, limit: int | None = None) -> DataFrame:
    """The topics asked for, in the order asked; a missing id is an error."""
    if not ids:
        return topics.orderBy("topic_id").limit(limit) if limit else topics
    wanted = [x.strip() for x in ids.split(",") if x.strip()]
    spark = topics.sparkSession
    order = F.broadcast(spark.createDataFrame(list(enumerate(wanted)), "pos int, topic_id string"))
    missing = [r.topic_id for r in order.join(topics, "topic_id", "left_anti").collect()]
    if missing:
        raise ValueError(f"no such topics: {missing}")
    rows = topics.join(order, "topic_id").orderBy("pos").drop("pos")
    return rows.limit(limit) if limit else rows


def qrels_text(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, nct_id, grade): lines of four fields or more with a whole grade; the last of a pair wins."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("line"))
    rows = lines.where("size(f) >= 4").select(
        F.col("f")[0].alias("topic_id"), F.col("f")[2].alias("nct_id"), F.col("f")[3].try_cast("int").alias("grade"), "line"
    )
    return rows.where("grade is not null").groupBy("topic_id", "nct_id").agg(F.max_by("grade", "line").alias("grade"))


def thesaurus_xml(spark: SparkSession, path: str, supplemental: bool = False) -> DataFrame:
    """(concept_id, name, synonyms, tree_numbers) of a descriptor or supplemental file."""
    kind = "SupplementalRecord" if supplemental else "DescriptorRecord"
    key = "SupplementalRecord" if supplemental else "Descriptor"
    schema = f"""{key}UI string, {key}Name struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>,
      ConceptList struct<Concept:array<struct<TermList:struct<Term:array<struct<String:string>>>>>>"""
    raw = spark.read.format("xml").schema(schema).option("rowTag", kind).load(path)
    terms = F.flatten(F.transform("ConceptList.Concept", lambda x: x["TermList"]["Term"]["String"]))
    return raw.select(
        F.col(f"{key}UI").alias("concept_id"),
        F.col(f"{key}Name.String").alias("name"),
        F.array_distinct(_texts(terms)).alias("synonyms"),
        _texts(F.col("TreeNumberList.TreeNumber")).alias("tree_numbers"),
    )


def synonym_index(concepts: DataFrame) -> DataFrame:
    """(synonym, concept_ids): lower-cased names and synonyms to the concepts that have them."""
    words = F.array_distinct(F.transform(F.concat(F.array("name"), "synonyms"), lambda x: F.lower(F.trim(x))))
    rows = concepts.select("concept_id", F.explode(words).alias("synonym")).where("synonym <> ''")
    return rows.groupBy("synonym").agg(F.array_sort(F.collect_set("concept_id")).alias("concept_ids"))


def example_bank(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, category string, criterion_text string, patient_excerpt string, decision string, reasoning string"
    return spark.read.schema(schema).json(path).where("id is not null")


def bank_problems(bank: DataFrame, labels: tuple = ("met", "not_met", "NEI")) -> DataFrame:
    """(problem, key, n): unknown labels, repeated ids and texts, categories that lack a label."""
    bad = bank.where(~F.col("decision").isin(*labels)).select(F.lit("label").alias("problem"), F.col("id").alias("key"), F.lit(1).cast("long").alias("n"))
    twice = [
        bank.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"repeated {c}").alias("problem"), "key", "n")
        for c in ("id", "criterion_text")
    ]
    lacks = bank.groupBy(F.col("category").alias("key")).agg(
        F.least(F.count_if(F.col("decision") == "NEI"), F.count_if(F.col("decision") == "not_met")).alias("n")
    ).where("n = 0").select(F.lit("one-sided category").alias("problem"), "key", "n")
    return bad.unionAll(twice[0]).unionAll(twice[1]).unionAll(lacks)


def criterion_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, trial, criterion, label) of hand annotations, one JSON object a line; the last of a key wins."""
    schema = "topic_id string, nct_id string, criterion_id string, label string"
    rows = spark.read.schema(schema).json(path).withColumn("line", F.monotonically_increasing_id())
    rows = rows.where("topic_id is not null and nct_id is not null and criterion_id is not null and label in ('met', 'not_met', 'NEI')")
    last = rows.groupBy("topic_id", F.col("nct_id").alias("trial"), F.col("criterion_id").alias("criterion")).agg(F.max_by("label", "line").alias("label"))
    return last


def predictions_run(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, nct_id, score, position) of a predictions file."""
    schema = "topics array<struct<topic_id:string,ranked_trials:array<struct<nct_id:string,score:double,label:string,predicted_trec_qrel:int>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    t = raw.select(F.explode("topics").alias("t")).select("t.topic_id", F.posexplode("t.ranked_trials").alias("position", "r"))
    return t.select("topic_id", "r.nct_id", "r.score", "position", "r.label", "r.predicted_trec_qrel")

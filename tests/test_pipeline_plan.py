from pyspark.sql import functions as F
from quillmatch.operators import eligibility as E
from quillmatch.operators import ranking as G
from quillmatch.operators.steplog import StepLog
from quillmatch.plans import pipeline as P
from quillmatch.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_match(spark):
    docs, topics = Q.documents(spark, SF), Q.topics(spark, SF).where("topic_id < 5")
    evals, trials = Q.evaluations(spark, SF), Q.trials(spark, SF)
    for config in (P.benchmark(output_k=15), P.clinical()):
        rows = P.match(docs, topics, evals, trials, config).collect()
        by = {}
        for r in rows:
            by.setdefault(r.topic_id, []).append(r)
        assert len(by) == 5
        for got in by.values():
            got.sort(key=lambda r: r["rank"])
            assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len(got) <= config.output_k
            assert len({r.doc_id for r in got}) == len(got)
            assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_match_text(spark):
    docs = Q.documents(spark, SF)
    first = docs.orderBy("doc_id").first()
    got = P.match_text(spark, docs, first.text, 3).collect()
    assert got[0].doc_id == first.doc_id and len(got) == 3


def test_protected_ranks(spark):
    docs, topics = Q.documents(spark, SF), Q.topics(spark, SF).where("topic_id < 3")
    run = P.retrieve(docs, topics, P.benchmark())
    again = P.term_rerank(run, docs, topics, P.benchmark(entity_weight=0.09))
    assert again.count() == run.count()


def profiled(spark):
    """Two people against five documents, with one study of the wrong age and one that is not in the registry."""
    docs = spark.createDataFrame(
        [(k, f"melanoma trial{k}\npembrolizumab arm{k}\nmelanoma stage IV adults") for k in range(1, 6)], "doc_id long, text string"
    )
    topics = spark.createDataFrame([(0, "melanoma pembrolizumab"), (1, "melanoma adults")], "topic_id long, text string")
    who = "topic_id long, age_years double, sex string, home string, diagnoses array<string>, biomarkers array<string>, treatments array<string>, comorbidities array<string>, note string"
    people = spark.createDataFrame(
        [(0, 40.0, "male", "USA", ["melanoma"], ["BRAF"], ["pembrolizumab"], [], "melanoma"), (1, None, None, None, [], [], [], [], None)], who
    )
    studies = docs.where("doc_id < 5").selectExpr(
        "doc_id", "'RECRUITING' as status", "'ALL' as sex", "if(doc_id = 2, 60 * 365, 0) as min_days", "cast(null as int) as max_days",
        "if(doc_id = 2, '60 Years', null) as raw_min", "cast(null as string) as raw_max",
        "array(struct('United States' as country, '' as state, '' as city)) as locations", "split(text, '\n')[0] as title",
        "cast(null as string) as official_title", "'' as brief_summary", "cast(null as string) as detailed_description", "array('melanoma') as conditions",
        "array('x') as keywords", "array('pembrolizumab') as interventions", "text as inclusion_text", "'' as exclusion_text", "text as raw_text",
    )
    evals = spark.createDataFrame(
        [
            (t, *e)
            for t in (0, 1)
            for e in [(1, 1, "inclusion", "met", 0.9, True, "diagnosis"), (3, 1, "exclusion", "met", 0.9, False, "lab"), (4, 1, "inclusion", "NEI", 0.5, False, "age")]
        ],
        "topic_id long, trial long, criterion int, polarity string, label string, confidence double, mandatory boolean, type string",
    )
    trials = studies.selectExpr("doc_id as trial", "status", "'PHASE2' as phase", "date'2001-01-01' as updated")
    return docs, topics, evals, trials, people, studies


def by_topic(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.topic_id, r["rank"])):
        out.setdefault(r.topic_id, []).append(r)
    return out


def test_profiles_filter_label_and_fill(spark):
    docs, topics, evals, trials, people, studies = profiled(spark)
    got = by_topic(P.match(docs, topics, evals, trials, P.benchmark(), people, studies))
    first = {r.doc_id: r for r in got[0]}
    assert set(first) == {1, 2, 3, 4}  # 5 has no study and may not fill
    assert got[0][0].doc_id == 1 and first[1].label == "eligible" and first[1].source == "ranked"
    assert first[3].label == "excludes" and first[3].score < -0.9
    # too young for study 2, so it only fills, below all that is ranked
    assert first[2].source == "excluded" and got[0][-1].doc_id == 2 and first[2].score <= -2 + 0.001
    assert {r.doc_id: r.source for r in got[1]}[2] == "ranked"  # an unknown age passes
    bare = by_topic(P.match(docs, topics, evals, trials, P.benchmark(fill_excluded=False), people, studies))
    assert {r.doc_id for r in bare[0]} == {1, 3, 4}


def test_geography_counts(spark):
    docs, topics, evals, trials, people, studies = profiled(spark)
    near = by_topic(P.match(docs, topics, evals, trials, P.benchmark(), people, studies))[0]
    far = by_topic(P.match(docs, topics, evals, trials, P.benchmark(), people.withColumn("home", F.lit("France")), studies))[0]
    assert near[0].doc_id == far[0].doc_id == 1 and near[0].score > far[0].score


def test_irrelevance_needs_its_signals(spark):
    docs, topics, evals, trials, people, studies = profiled(spark)
    other = people.withColumns({"diagnoses": F.array(F.lit("asthma")), "treatments": F.array(F.lit("salbutamol")), "biomarkers": F.array().cast("array<string>")})
    got = by_topic(P.match(docs, topics, evals, trials, P.benchmark(), other, studies))[0]
    labels = {r.doc_id: r.label for r in got}
    assert labels[1] == "eligible" and labels[3] == "excludes"
    low = {r.doc_id for r in got if r.label == "irrelevant"}
    assert low <= {4}  # nothing known of its criteria; irrelevant only if its prior is low, too
    off = by_topic(P.match(docs, topics, evals, trials, P.benchmark(irrelevance=False), other, studies))[0]
    assert "irrelevant" not in {r.label for r in off}


def test_outside_selection_is_demoted(spark):
    rows = spark.createDataFrame([(0, 1, False, 0.5), (0, 2, False, 0.3), (0, 3, True, 0.9), (0, 4, True, 0.1), (1, 5, True, 0.7)], "topic_id long, doc_id long, outside boolean, score double")
    got = {r.doc_id: round(r.score, 6) for r in G.demote_outside(rows).collect()}
    assert got == {1: 0.5, 2: 0.3, 3: 0.299, 4: 0.1, 5: 0.7}
    docs, topics, evals, trials, people, studies = profiled(spark)
    got = by_topic(P.match(docs, topics, evals, trials, P.benchmark(diverse=True, evaluated=2, diverse_keep=1), people, studies))
    assert all(len([r for r in rs if r.source == "ranked"]) == 2 for rs in got.values())


def test_two_patients_one_trial(spark):
    """What one patient meets or fails says nothing of the other."""
    docs, topics, evals, trials, people, studies = profiled(spark)
    own = evals.withColumn("label", F.when((F.col("trial") == 1) & (F.col("topic_id") == 1), "not_met").otherwise(F.col("label")))
    got = by_topic(P.match(docs, topics, own, trials, P.benchmark(irrelevance=False), people, studies))
    labels = {t: {r.doc_id: r.label for r in rows} for t, rows in got.items()}
    assert (labels[0][1], labels[1][1]) == ("eligible", "excludes") and labels[0][3] == labels[1][3] == "excludes"
    scores = {t: {r.doc_id: r.score for r in rows} for t, rows in got.items()}
    assert scores[0][1] > 0 > scores[1][1]
    alone = by_topic(P.match(docs, topics, own.where("topic_id = 0"), trials, P.benchmark(irrelevance=False), people, studies))
    assert {r.doc_id: (r.label, r.score) for r in alone[0]} == {r.doc_id: (r.label, r.score) for r in got[0]}
    counts = {(r.topic_id, r.trial): (r.n_inc, r.inc_met) for r in E.trial_counts(own).collect()}
    assert counts[0, 1] == (1, 1) and counts[1, 1] == (1, 0)


def test_judge_and_critique(spark):
    docs, topics, evals, trials, people, studies = profiled(spark)
    plain = [r.doc_id for r in by_topic(P.match(docs, topics, evals, trials, P.benchmark(), people, studies))[0]]
    last = plain[2]
    order = spark.createDataFrame([(0, last, 1), (0, 77, 0), (0, plain[3], 0)], "topic_id long, doc_id long, place int")
    got = by_topic(P.match(docs, topics, evals, trials, P.benchmark(), people, studies, order=order))
    assert [r.doc_id for r in got[0]] == [last, plain[0], plain[1], plain[3]]  # a fill stays behind
    assert [r["rank"] for r in got[0]] == [1, 2, 3, 4] and len(got[1]) > 0
    flagged = spark.createDataFrame([(0, plain[0])], "topic_id long, doc_id long")
    got = by_topic(P.match(docs, topics, evals, trials, P.benchmark(), people, studies, flagged=flagged))
    assert [r.doc_id for r in got[0]] == [plain[1], plain[2], plain[0], plain[3]]


def test_steps_are_logged_without_jobs_of_their_own(spark):
    docs, topics, evals, trials, people, studies = profiled(spark)
    log = StepLog()
    P.match(docs, topics, evals, trials, P.benchmark(), people, studies, log=log).collect()
    rows = log.table(spark).orderBy("place").collect()
    assert [r.step for r in rows] == ["screened", "selected", "labelled", "scored"]
    assert [r.rows for r in rows][1:] == [rows[1].rows] * 3 and all(r.seconds > 0 and r.error is None for r in rows)


def test_step_log(spark):
    a, b = StepLog(), StepLog()
    assert a.step("ten", spark.range(10)).count() == 10 and a.step("none", lambda: spark.range(0)).count() == 0
    try:
        b.step("broken", spark.range(3).select(F.raise_error(F.lit("no"))))
        raise AssertionError
    except Exception as e:
        assert "no" in str(e)
    a.count("calls", 2), b.count("calls"), b.count("retries", None), b.fail("a note")
    both = a.merge(b)
    assert [(s[0], s[1], s[2]) for s in both.steps] == [(1, "ten", 10), (2, "none", 0), (3, "broken", None)]
    assert both.counters == {"calls": 3, "retries": 0} and both.errors[1] == "a note" and both.errors[0].startswith("broken: ")
    assert a.table(spark).count() == 2 and StepLog().table(spark).count() == 0

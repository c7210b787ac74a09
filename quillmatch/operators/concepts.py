"""Thesaurus concepts of terms, by the first lookup key that is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import criteria as C
from quillmatch.operators.retrieval import small


def expanded(synonyms: Column, most: int = 8) -> Column:
    """The first ``most`` synonyms, each once whatever its case, in order."""
    lower = F.transform(synonyms, lambda s: F.lower(s))
    firsts = F.filter(synonyms, lambda s, i: F.array_position(lower, F.lower(s)) == i + 1)
    return F.slice(firsts, 1, most)


def normalised(terms: DataFrame, book: DataFrame) -> DataFrame:
    """(key, pos, concept_id, name, synonyms): concepts of each term under its first known key.

    ``terms``: key, pos, term; ``book``: alias (lower-case), concept_id, name, synonyms.
    """
    keys = terms.select("key", "pos", F.posexplode(C.lookup_keys(F.col("term"))).alias("tried", "alias"))
    hits = keys.join(small(book), "alias")
    first = hits.groupBy("key", "pos").agg(F.min("tried").alias("tried"))
    return hits.join(first, ["key", "pos", "tried"]).select("key", "pos", "concept_id", "name", "synonyms").distinct()


def annotated(terms: DataFrame, book: DataFrame) -> DataFrame:
    """(key, concepts): each key's concepts in the order of its terms, with eight synonyms at most."""
    one = F.struct("pos", "concept_id", "name", F.slice("synonyms", 1, 8).alias("synonyms"))
    rows = normalised(terms, book).groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("x"))
    plain = lambda c: F.struct(c["concept_id"].alias("concept_id"), c["name"].alias("name"), c["synonyms"].alias("synonyms"))
    return rows.select("key", F.transform("x", plain).alias("concepts"))

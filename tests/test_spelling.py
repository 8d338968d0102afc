"""Classes of spellings against every pair compared."""

import random

from viewmart.operators import spelling_clusters, with_class_names
from viewmart.session import settle


def classes(spark, counts):
    df = spark.createDataFrame([("t", v, n) for v, n in counts], "k string, Value string, Row_Count long").repartition(3)
    found = {}
    for r in spelling_clusters(df, ["k"]).collect():
        found.setdefault(r.Class_Name, set()).add(r.Value)
        assert r.Class_Rows == sum(n for v, n in counts if v in found[r.Class_Name]) or r.Class_Spellings > len(found[r.Class_Name])
    return found


def test_spellings_of_one_word_meet_and_others_do_not(spark):
    counts = [
        ("Closed", 90), ("closed", 20), ("CLOSED", 30), ("Clsd", 5), (" closed.", 2), ("clozed", 1), ("Open", 50), ("OPEN", 9), ("On Hold", 40),
        ("AMERICA", 9), ("AFRICA", 8), ("720p", 3), ("480p", 3), ("1080P", 2), ("1080p", 4), ("gateway 3", 6), ("gateway 4", 6), ("Unemployed", 4),
        ("employed", 7), ("Self-Employed", 5), ("self employed", 2), ("!!!", 1), ("???", 1), ("", 2), (None, 3), ("Größe", 2), ("GRÖSSE", 1),
    ]
    found = classes(spark, counts)
    assert found["Closed"] == {"Closed", "closed", "CLOSED", "Clsd", " closed.", "clozed"}
    assert found["Open"] == {"Open", "OPEN"} and found["1080p"] == {"1080p", "1080P"} and found["Self-Employed"] == {"Self-Employed", "self employed"}
    alone = ["On Hold", "AMERICA", "AFRICA", "720p", "480p", "gateway 3", "gateway 4", "Unemployed", "employed", "!!!", "???", ""]
    assert all(found[name] == {name} for name in alone)
    assert set().union(*found.values()) == {v for v, _ in counts if v is not None}


def test_long_chains_are_one_class(spark):
    """Each word is one letter from the next; the ends are far apart."""
    rng, word, chain = random.Random(2), list("bcdfghjklmnpqrstvwxz"), []
    for i in range(len(word)):
        chain.append("".join(word))
        word[i] = rng.choice([c for c in "bcdfghjklmnpqrstvwxz" if c not in (word[i], word[i - 1], word[(i + 1) % len(word)])])
    found = classes(spark, [(w, 1) for w in chain] + [("zyxwvtsrqpnmlkjhgfdcb", 1)])
    assert sorted(map(len, found.values())) == [1, len(chain)]


def test_values_take_the_name_of_their_class(spark):
    df = spark.createDataFrame([(1, "Closed"), (2, "Closed"), (3, "clsd"), (4, None), (5, "new")], "id int, Status string")
    counts = df.where("id < 5").groupBy("Status").count().selectExpr("'Status' AS k", "Status AS Value", "count AS Row_Count")
    named = with_class_names(df, "Status", settle(spelling_clusters(counts, ["k"]), "spellings"))
    assert sorted((r.id, r.Status) for r in named.collect()) == [(1, "Closed"), (2, "Closed"), (3, "Closed"), (4, None), (5, "new")]
    assert spelling_clusters(counts.where("false"), ["k"]).count() == 0

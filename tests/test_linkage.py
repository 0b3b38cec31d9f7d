import random

from mailweir.operators import linkage as K
from mailweir.plans import analysis_queries as Q

COLUMNS = ("id", "sender", "receiver", "date", "subject", "body", "language", "parent_id", "group_id")


def write(spark, folder):
    r = random.Random(3)
    mailboxes = [f"{a}@mail.example" for a in "abcdef"]
    pages = [f"https://www.site{i}.example/p" for i in range(6)]
    words = [f"harbour{c}" for c in "abcdefghijkl"]
    rows = []
    for i in range(60):
        body = " ".join(r.sample(words, 3) + r.sample(pages, r.randint(0, 2)) + [str(r.randint(10, 40)), f"AB-{r.randint(100, 130)}"])
        if i == 7:
            body = None
        language = "en" if i % 2 else "vi"
        rows.append((f"m{i:02}", r.choice(mailboxes), None, "2024-01-02", r.choice(["", None, " ".join(r.sample(words, 2))]), body, language, "", None))
    rows += [("n1", "only@here.example", None, None, None, "x", "en", "", None), ("n2", None, "only@here.example", None, None, "y", "vi", "", None)]
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS)).write.parquet(f"{folder}/messages.parquet")
    return str(folder)


def brute(left, right):
    """F52 over all pairs."""
    df = {f: {} for f in K.FIELDS}
    for a in left:
        for f in K.FIELDS:
            for v in a[f]:
                df[f][v] = df[f].get(v, 0) + 1
    out, blocked = {}, {}
    for a in left:
        for b in right:
            both = {f: sorted(set(a[f]) & set(b[f])) for f in (*K.FIELDS, "subject_tokens")}
            rare = sum(df[f][v] <= K.CAPS[f] for f in K.FIELDS for v in both[f])
            if not rare:
                continue
            blocked[a["id"], b["id"]] = rare
            p = sum(5.0 if df["emails"][v] <= 3 else 3.0 for v in both["emails"][:3]) + sum(6.0 if df["urls"][v] <= 3 else 4.0 for v in both["urls"][:3])
            p += min(6.0, 2.0 * len(both["identifiers"])) + min(4.0, 1.25 * len(both["subject_tokens"]))
            p += min(10.0, sum({1: 2.5, 2: 1.75, 3: 1.75}.get(df["tokens"][v], 1.0) for v in both["tokens"][:10]))
            p += min(5.0, sum(1.5 if df["numbers"][v] == 1 else 0.75 for v in both["numbers"][:8]))
            p += 0.5 if a["n_chars"] and 0.55 <= b["n_chars"] / a["n_chars"] <= 2.6 else 0.0
            out[a["id"], b["id"]] = p
    return out, blocked


def test_all_fields_against_brute_force(spark, tmp_path):
    d = write(spark, tmp_path)
    points, blocked = brute(*([r.asDict() for r in side.collect()] for side in Q._sides(spark, d)))
    got = {(r["left_id"], r["right_id"]): r["n_shared"] for r in Q.QUERIES["blocking_candidates"](spark, d).collect()}
    assert got == blocked and ("n1", "n2") in got  # a mailbox alone blocks
    rows = Q.QUERIES["link_topk"](spark, d).collect()
    for right in {b for _, b in points}:
        order = sorted((-p, a) for (a, b), p in points.items() if b == right)
        mine = sorted((r for r in rows if r["right_id"] == right), key=lambda r: r["candidate_rank"])
        assert [(-r["points"], r["left_id"]) for r in mine] == order[:3]
        assert mine[0]["margin"] == -order[0][0] + (order[1][0] if len(order) > 1 else 0.0)

"""Nested containers, tied members and ordered differences against plain code."""
import random
import re

from pyspark.sql import functions as F

from cargolens.operators import compare, gates


def plain_nested(rows, levels, most, member_bytes, total):
    """Members of one mail, walked as a tree with one budget."""
    children, at = {}, {r["pos"]: r for r in rows}
    for r in rows:
        children.setdefault(r["parent"], []).append(r)
    reached, taken, left, room = set(), [], most, total

    def visit(parent, layer, opened):
        nonlocal left, room
        names = set()
        for r in sorted(children.get(parent, []), key=lambda r: r["pos"]):
            reached.add(r["pos"])
            n = (r["name"] or "").replace("\\", "/")
            base = n.rsplit("/", 1)[-1]
            ok = opened and layer <= levels and bool(base) and not base.startswith(".") and not n.startswith("/") and ".." not in n.split("/")
            ok = ok and bool(r["safe"]) and r["size"] is not None and r["size"] <= member_bytes and base not in names and left > 0 and r["size"] <= room
            if ok:
                names.add(base)
                taken.append((r["pos"], base))
                left -= 1
                room -= r["size"]
            visit(r["pos"], layer + 1, ok and bool(r["container"]))

    visit(None, 1, True)
    return taken, len(rows) - len(taken), set(at) - reached


def test_nested_containers_share_one_budget(spark):
    rng, rows = random.Random(6), []
    for mail in range(60):
        for pos in range(1, rng.randrange(2, 25)):
            parent = rng.choice([None, *range(1, pos)]) if rng.random() < 0.9 else 999  # some name a container that is not there
            rows.append({"mail": mail, "pos": pos, "parent": parent, "name": rng.choice(["a.zip", "b/c.pdf", "../x", ".h", "d.pdf", f"f{pos}.pdf", None]),
                         "size": rng.choice([1, 5, 9, 30, None]), "safe": rng.choice([True, True, True, False, None]), "container": rng.random() < 0.6})
    rows += [{"mail": 900, "pos": 1, "parent": 2, "name": "loop", "size": 1, "safe": True, "container": True}, {"mail": 900, "pos": 2, "parent": 1, "name": "loop", "size": 1, "safe": True, "container": True}]
    schema = "mail long, pos int, parent int, name string, size long, safe boolean, container boolean"
    members = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    for levels in (1, 2, 3):
        got = {r.mail: r for r in gates.admit_nested(gates.walked_members(members, levels), levels, 6, 10, 40).collect()}
        for mail, r in got.items():
            mine = [x for x in rows if x["mail"] == mail]
            taken, refused, _ = plain_nested(mine, levels, 6, 10, 40)
            assert [(t.path[-1], t.name) for t in r.taken] == taken and len(r.refused) == refused
    reasons = {(x.path[-1], x.reason) for x in got[900].refused}
    assert reasons == {(1, "depth"), (2, "depth")}


def test_depth_costs_no_plan(spark):
    """A chain of 200 containers: as many joins as layers may be opened."""
    chain = spark.createDataFrame([(1, i, i - 1 if i > 1 else None, f"c{i}.zip", 1, True, True) for i in range(1, 201)],
                                  "mail long, pos int, parent int, name string, size long, safe boolean, container boolean")
    r = gates.admit_nested(gates.walked_members(chain, 2), 2, 25, 10, 100).first()
    assert [t.path for t in r.taken] == [[1], [1, 2]] and {x.reason for x in r.refused} == {"depth"} and len(r.refused) == 198
    assert gates.admit_nested(gates.walked_members(chain.limit(0), 2), 2, 25, 10, 100).count() == 0


def test_tied_members_give_one_result(spark):
    rows = [(1, 1, "in/a.pdf", 6, True), (1, 1, "in/a.pdf", 4, True), (1, 2, "in/b.pdf", 5, False), (1, 2, "in/b.pdf", 5, True), (1, 3, "in/c.pdf", 6, True)]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "mail long, pos int, name string, size long, safe boolean").repartition(3)
        m = df.groupBy("mail").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "size", "safe"))).alias("members"))
        r = gates.admit_members(m, 25, 10, 10).first()
        seen.add((tuple(r.taken), tuple((x.name, x.reason) for x in r.refused)))
    assert seen == {(("a.pdf", "b.pdf"), (("in/a.pdf", "repeated"), ("in/b.pdf", "unsafe"), ("in/c.pdf", "total")))}


TOKEN = re.compile(r"[A-Za-z0-9]+(?:[.'’/-][A-Za-z0-9]+)*|\s+|[^\sA-Za-z0-9]+")


def plain_difference(x, y):
    a, b = TOKEN.findall(x or ""), TOKEN.findall(y or "")
    if not a or not b or len(a) * len(b) > compare.DIFF_CELLS:
        return None
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            longest[i][j] = longest[i + 1][j + 1] + 1 if a[i] == b[j] else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and longest[i + 1][j] >= longest[i][j + 1]:
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("ins", b[j]))
            j += 1
    return out


def test_ordered_difference_equals_plain_code(spark):
    rng = random.Random(1)
    words = ["ACME", "LTD.", "ltd", "O'Neil", "12/4", ",", " ", "\n ", "(x)", "é", "a-b.c"]
    pairs = [("".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(12))), "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(12)))) for _ in range(150)]
    pairs += [(None, "a"), ("a", None), ("", ""), ("same text", "same text"), ("a b " * 60, "b a " * 60), ("a " * 400, "a " * 400)]
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", compare.aligned_difference(compare.tokens(F.col("x")), compare.tokens(F.col("y"))).alias("d"))
    for r in df.collect():
        assert (None if r.d is None else [(o.op, o.token) for o in r.d]) == plain_difference(r.x, r.y), (r.x, r.y)

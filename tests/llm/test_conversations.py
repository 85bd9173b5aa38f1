"""Conversation repair against all sequences of edits, the SQL on odd rows, and pieces of a few rows."""

import hashlib
import random
import re
from functools import cache

import duckdb
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import conversations as C
from pagequarry.llm.queries import ORACLE_SQL, op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def slow(rows):
    """All that the contract asks of one conversation's rows (turn, role, text), by trying every edit."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        left = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not left else "d" if (role, text) in seen else "t" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)

    @cache
    def best(i, said, fresh):
        """The least (cost, audit, lines) from row i on; said: the initials so far, shortened; fresh: how many rows were just inserted."""
        out = []
        if i == n:
            if re.fullmatch("(s?(ua)+)?", said):
                out.append((0, "", ()))
        else:
            _, role, text = rows[i]
            out.append(ahead(4, "D", None, best(i + 1, said, 0)))
            if faults[i] not in ("b", "d"):
                more = 3 * (faults[i] == "t")
                out.append(ahead(more, "K", f"{role}:{text}", after(i + 1, said, role[:1], 0)))
                out += [ahead(3 + more, "R", f"{to}:{text}", after(i + 1, said, to[0], 0)) for to in ("user", "assistant")]
        if fresh < 3:
            out += [ahead(3, "I", f"{to}:", after(i, said, to[0], fresh + 1)) for to in ("user", "assistant")]
        return min((o for o in out if o), default=None)

    def after(i, said, initial, fresh):
        said += initial
        if not initial or not re.fullmatch("s?(ua)*u?", said):
            return None
        return best(i, re.sub("(ua)+", "ua", said), fresh)

    def ahead(cost, letter, line, rest):
        return rest and (cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2])

    cost, audit, lines = best(0, "", 0)
    turns = [r[0] for r in rows if r[0] is not None]
    heads = [r[1][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in "bdt"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def talks(seed, n, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", ""]
    texts = ["Yes.", "No", "", " \n", "Why?", "Go on! ", "é…", "So. ", "So.\u0085", "a" * 3000 + "."]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(roles) if rng.random() < 0.5 else roles[t % 2]
            rows.append((c, None if rng.random() < 0.05 else t // rng.choice([1, 1, 2]), role, rng.choice(texts) if rng.random() < 0.5 else f"Line {rng.randrange(30)}{rng.choice('.!x')}"))
    return rows


def columns(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


@pytest.mark.parametrize("most", [3, 512])
def test_repair(spark, most):
    rows = talks(most, 120, 9) + talks(9, 1, 60)
    got = {r.conv_id: columns(r) for r in C.repair(C.as_they_are(spark.createDataFrame(rows, SCHEMA)), most).collect()}
    for c in {r[0] for r in rows}:
        assert got[c] == slow([r[1:] for r in rows if r[0] == c])


def test_long_conversation_in_many_pieces(spark):
    """One conversation holds most rows, one row of it stands there very often; small pieces give what one search gives."""
    rows = talks(4, 1, 900) + [(0, 5, "user", "Again.")] * 300 + talks(5, 30, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = ({r.conv_id: columns(r) for r in C.repair(C.as_they_are(df.repartition(7)), most).collect()} for most in (10**6, 5))
    assert one == many and len(one[0][6]) > 500


def test_damage_and_sql(spark, tmp_path):
    rows = talks(1, 300, 7) + [(None, None, None, None), (None, 0, "user", "Hi."), (None, 1, None, "x"), (900, None, "user", None), (901, None, None, None)] + talks(1, 20, 7)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    names = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    got = sorted((tuple(r) for r in op11_conversation_repair(spark, str(tmp_path)).selectExpr(*names.split(", ")).collect()), key=str)
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(c.execute(f"select {names} from ({ORACLE_SQL['op11_conversation_repair']})").fetchall(), key=str) == got
    assert len(got) == len({r[0] for r in rows}) and any(r[7] == "" for r in got)


def test_edges(spark):
    assert C.repair(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    one = spark.createDataFrame([(7, 2, "user", "x" * 5_000_000), (7, 3, "assistant", "Done.")], SCHEMA).selectExpr("*", "1 as n", "2 as fault", "3 as piece", "4 as digest")
    got = C.repair(C.as_they_are(one)).collect()
    assert [(r.cost, r.audit, r.truncated) for r in got] == [(3, "KK", 1)]
    kinds = C.damaged(spark.range(2000).selectExpr("id as conv_id", "id as turn", "'system' as role", "'a.b!' as text")).groupBy("n", "role", "text").agg(F.count("*").alias("c")).collect()
    assert {(r.n, r.role, r.text) for r in kinds} == {(0, None, None), (1, "system", ""), (1, "system", "ab"), (2, "system", "a.b!"), (1, "user", "a.b!"), (1, "system", "a.b!")}

import hashlib
import heapq
import random
import re
import zlib

from carryover.llm import dialogues as D

RND = random.Random(5)
EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The contract read word by word: best-first search over edit strings, no states."""
    out = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    turns = [t for t, _, _ in rows if t is not None]
    if turns:
        out["gaps"] = max(turns) - min(turns) + 1 - len(set(turns))
    kinds, seen = [], set()
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    for k in kinds:
        if k:
            out[k] += 1
    out["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, best = [(0, "", 0, ())], None
    while heap:
        cost, audit, at, made = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
            best = min(best or (cost, audit, made), (cost, audit, made))
        if len(made) > len(rows) + 2:
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, (*made, (role, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, made))
            if kinds[at] not in ("blank", "duplicate"):
                more = 3 * (kinds[at] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*made, (role, text))))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, (*made, (r, text))))
    cost, audit, made = best
    return tuple(out.values()) + (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()), made


def ordered(rows):
    return sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def report(df, **more):
    return {r[0]: tuple(r)[1:] for r in D.repair_report(df, **more).collect()}


def some(n):
    role = lambda: RND.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None])
    text = lambda: RND.choice(["Yes.", "No!", "Why? ", "cut off", "", " \n", None, "Other.\n"])
    return [(RND.choice([None, 0, 1, 2, 3, 5, 9]), role(), text()) for _ in range(n)]


def test_report_equals_search(spark):
    convs = {i: some(RND.randrange(1, 6)) for i in range(120)} | {None: [(0, "user", "Hi."), (0, "user", "Hi."), (1, "assistant", "Yo")]}
    df = spark.createDataFrame([(c, *r) for c, rs in convs.items() for r in rs], SCHEMA)
    got = report(df)
    made = {}
    for r in D.repair_conversations(df).collect():
        made.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    for c, rs in convs.items():
        want, turns = plain(ordered(rs))
        assert got[c] == want, (c, rs)
        assert [(r, t) for _, r, t in sorted(made.get(c, []))] == list(turns)


def test_long_conversation_spills(spark, monkeypatch):
    rows = [(t, RND.choice(["user", "assistant", "system"]), f"Turn {t % 1500}{'.' if t % 7 else ''}") for t in range(3000)]
    whole = D.Conversation(1)
    for r in rows:
        whole.add(*r)
    want = whole.report()
    assert not whole.tape.parts and not whole.seen.runs
    monkeypatch.setattr(D, "SPILL", 2000)
    monkeypatch.setattr(D, "RUN", 100)
    cut = D.Conversation(1)
    for r in rows:
        cut.add(*r)
    assert len(cut.tape.parts) > 10 and len(cut.seen.runs) > 1
    assert cut.report() == want and want[3] > 0


def test_across_batches_and_clashing_columns(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Line {t}." * 50, "x", "y") for c in (1, 2) for t in range(12_000)]
    got = report(spark.createDataFrame(rows, SCHEMA + ", conv string, gone string"))
    assert got[1] == got[2] and got[1][:6] == (0, 0, 0, 0, 0, 0) and got[1][6] == "K" * 12_000


def test_absent_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (2, 4, "user", "Gone.")], SCHEMA)
    got = report(df, absent=df.conv_id == 2)
    assert got[2] == (0, 0, 0, 0, 0, 0, "", EMPTY) and got[1][6] == "KK"
    assert report(df.limit(0)) == {}


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, r, x) for c in (*range(60), None) for t, r, x in ((0, "system", "Be kind."), (1, "user", "Why? Well."), (None, None, None))]
    df, gone = D.damaged(spark.createDataFrame(rows, SCHEMA))
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in df.filter(~gone).collect()), key=repr)
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        r, x = "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        want += [(c, t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want, key=repr)

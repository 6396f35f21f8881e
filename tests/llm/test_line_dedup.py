from keidai.llm.line_dedup import line_dedup


def brute(rows, window=3):
    seen, out = {}, []
    lines = {i: t.split("\n") for i, t in rows if t is not None and i is not None}
    gone = {i: set() for i in lines}
    for i in sorted(lines):
        for p in range(len(lines[i]) - window + 1):
            w = tuple(lines[i][p : p + window])
            if not any(x.strip(" ") for x in w):
                continue
            if w in seen:
                gone[i] |= set(range(p, p + window))
            seen.setdefault(w, (i, p))
    for i, t in rows:
        out.append((i, t if i not in lines else "\n".join(x for p, x in enumerate(lines[i]) if p not in gone[i])))
    return sorted(out, key=str)


def run(df):
    return sorted(((r["doc_id"], r["text"]) for r in line_dedup(df).collect()), key=str)


def test_later_windows_go_and_covered_lines_merge(make):
    rows = list(enumerate(["a\nb\nc\nd", "x\na\nb\nc\nd\ny", "b\nc\nd", "q\nq\nq\nq\nq", "", None, "\n\n\n\n", "\n\n\n\n\n", "a\nb", " \n\t\n", "a\nb\nc\nd"]))
    assert run(make(rows)) == brute(rows)
    assert dict(run(make(rows)))[1] == "x\ny"
    assert dict(run(make(rows)))[2] == ""


def test_random_lines(make):
    import random

    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abc ") for _ in range(rng.randint(0, 12)))) for i in range(150)]
    assert run(make(rows)) == brute(rows)


def test_repeated_rows_null_ids_empty_table_and_long_text(make, spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc")]
    assert run(make(rows)) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, ""), (None, "a\nb\nc")]
    assert run(make(rows).limit(0)) == []
    long = "\n".join(f"line {i % 5000}" for i in range(20_000))
    assert run(make([(0, long)])) == [(0, "\n".join(f"line {i}" for i in range(5000)) )] or run(make([(0, long)])) == brute([(0, long)])


def test_columns_stay(make):
    df = make(["a"])
    out = line_dedup(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert line_dedup(out).columns == out.columns


def test_clashing_names_in_any_case(make):
    from pyspark.sql import functions as F

    clash = make(["a\nb\nc", "a\nb\nc\nd"]).withColumns({c: F.lit(c) for c in ("ld_text", "ld_key", "ld_lines", "ld_cover", "ld_kept", "ld_row", "ld_id", "LD_H")})
    out = {r["doc_id"]: r for r in line_dedup(clash).collect()}
    assert out[1]["text"] == "d" and all(out[1][c] == c for c in ("ld_text", "ld_key", "ld_lines", "ld_cover", "ld_kept", "ld_row", "ld_id", "LD_H"))
    again = line_dedup(clash.withColumn("N_Lines", F.lit("old")))
    assert [c for c in again.columns if c.lower() == "n_lines"] == ["n_lines"] and again.where("doc_id = 1").first()["n_lines"] == 4

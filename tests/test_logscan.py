"""The log scan against Python's own csv reader: ranges, quotes, dialects, widths."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tripflow.plans import ingest
from tripflow.sources import logscan

MAP = {"a": "a", "b": "b"}
HOSTILE = ['"', '""', "\n", ";", "x", "1", "2.5", " ", "\r\n", 'y"z', "€"]


def plain(raw: bytes, sep: str, encoding: str = "cp1252") -> list[tuple]:
    """(a, b, further copies of a, other fields) per record, as text."""
    rows = list(csv.reader(io.StringIO(raw.decode(encoding), newline=""), delimiter=sep))
    head = [h.strip() for h in rows[0]]
    out = []
    for r in rows[1:]:
        if not r or (len(r) == 1 and not r[0].strip()):
            continue
        at = lambda i: (r[i] or None) if i < len(r) else None  # noqa: B023, E731
        first, more, loose = {}, [], []
        for i in range(max(len(head), len(r))):
            s = head[i] if i < len(head) and head[i] in MAP else None
            if s is None:
                if at(i):
                    loose.append((i, at(i)))
            elif s in first:
                more.append(at(i))
            else:
                first[s] = at(i)
        out.append((first.get("a"), first.get("b"), tuple(more), tuple(loose)))
    return sorted(out, key=repr)


def scanned(spark, folder, size) -> dict[str, list[tuple]]:
    got = {}
    for r in logscan.scan(spark, str(folder), "*.csv", MAP, range_bytes=size).filter("fields IS NULL").collect():
        row = (r.a, r.b, tuple(m.value for m in r.more or []), tuple((x.position, x.value) for x in r.loose or []))
        got.setdefault(r.trip, []).append(row)
    return {k: sorted(v, key=repr) for k, v in got.items()}


def quoted(rng: random.Random, sep: str) -> str:
    text = "".join(rng.choice(HOSTILE) for _ in range(rng.randrange(5)))
    if rng.random() < 0.7 or sep in text or "\n" in text or text.startswith('"'):
        return '"' + text.replace('"', '""') + '"'
    return text


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_ranges_and_quotes_agree_with_a_plain_reader(spark, tmp_path, size):
    rng, want = random.Random(size), {}
    for n in range(6):
        sep = ";,"[n % 2]
        lines = [sep.join(["a", "b", "a", "other"])]
        lines += [sep.join(quoted(rng, sep) for _ in range(4)) for _ in range(25)]
        lines += [sep.join(["1"] * w) for w in (2, 3, 5, 9)]
        raw = ("\n".join(lines) + ("\n" if n % 3 else "")).encode("cp1252")
        (tmp_path / f"f{n}.csv").write_bytes(raw)
        want[f"f{n}"] = plain(raw, sep)
    assert scanned(spark, tmp_path, size) == want


def test_every_range_state_is_composed(spark, tmp_path):
    """Ranges that only keep or swap the state, and long runs of quotes over their borders."""
    body = "a;b\n" + "\n".join([f'"{"x" * 40}";1', '"' + '"' * 60 + '";2', f'"{"n" + chr(10)}{"n" * 30}";3', 'k"l;4'])
    (tmp_path / "q.csv").write_bytes(body.encode())
    want = plain(body.encode(), ";")
    for size in (1, 2, 3, 5, 11):
        assert scanned(spark, tmp_path, size)["q"] == want, size


def test_dialects_are_read_file_by_file(spark, tmp_path):
    head = "Time [s]{0}Cabin Temperature Sensor [°C]{0}Übrig ‰"
    (tmp_path / "w.csv").write_bytes((head.format(";") + "\n0;20;5\n").encode("cp1252"))
    (tmp_path / "l.csv").write_bytes(head.replace("‰", "\x81").format(",").encode("iso-8859-1") + b"\n0,21,5\n")
    (tmp_path / "u.csv").write_bytes((head.format(";") + "\n0;22;5\n").encode("utf-8-sig"))
    rows, extras = ingest.read_logs(spark, str(tmp_path))
    assert {r.trip: r.cabin_temp_c for r in rows.collect()} == {"w": 20.0, "l": 21.0, "u": 22.0}
    assert {(r.trip, r.header) for r in extras.collect()} == {("w", "Übrig ‰"), ("l", "Übrig \x81"), ("u", "Übrig ‰")}


def test_copies_belong_to_the_files_that_have_them(spark, tmp_path):
    """A signal that is doubled in one file is not reported as merged for the others."""
    (tmp_path / "one.csv").write_text("Time [s];Velocity [km/h]\n0;1\n1;2\n")
    (tmp_path / "two.csv").write_text("Time [s];Velocity [km/h];Velocity [km/h]]]\n0;1;\n1;;2\n")
    (tmp_path / "off.csv").write_text("Time [s];Velocity [km/h];Velocity [km/h]]];Velocity [km/h]\n0;1;9;1\n")
    rows, _ = ingest.read_logs(spark, str(tmp_path))
    got = {r.trip: (r.merged, r.conflicting, sorted(r.header_signals)) for r in rows.collect()}
    known = ["time_s", "velocity_kmh"]
    assert got == {"one": ([], [], known), "two": (["velocity_kmh"], [], known), "off": (["velocity_kmh"], ["velocity_kmh"], known)}


def test_empty_and_headless_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")       # Spark's listing leaves out what has no byte
    (tmp_path / "bad.csv").write_text("nothing here\n1\n")
    (tmp_path / "head.csv").write_text("Time [s];Velocity [km/h]\n")
    with pytest.raises(ValueError, match="could not parse .*bad.csv"):
        ingest.read_logs(spark, str(tmp_path))
    rows, extras = ingest.read_logs(spark, str(tmp_path), skip_unreadable=True)
    assert rows.count() == 0 and extras.count() == 0 and "velocity_kmh" in rows.columns
    with pytest.raises(FileNotFoundError):
        ingest.read_logs(spark, str(tmp_path), "*.none")


def test_plan_does_not_grow_with_headers(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"t{i}.csv").write_text(f"Time [s];Velocity [km/h];Own {i}\n0;{i};1\n")
    rows, extras = ingest.read_logs(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation ") == 1
    assert rows.agg(F.sum("velocity_kmh")).first()[0] == 66.0 and extras.count() == 12

"""The benchmark's report as Markdown and HTML, from frames whose rows are bounded by detectors and categories."""

from __future__ import annotations

import html
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Outcomes of which an example is shown, and how they are called.
SHOWN = {"TP": "caught drift", "FN": "missed drift", "FP": "false alarm on a negative control"}
ATTRIBUTIONS = ["retrieval", "reasoning", "n/a"]
#: Rows of any frame of a report; more mean that a frame of cases was given for one of totals.
MOST_ROWS = 1000


@dataclass(frozen=True)
class Frames:
    """What a report is made of. ``dataset``: ``reports.dataset_summary``; ``names``: (category, name, ord, is_drift); ``overall``:
    (detector, model, precision, recall, f1, false_alarm_rate, uncertain_rate, asked); ``categories``: (detector, category, n,
    value); ``attribution``: (detector, attribution, n); ``retrieval``: (category, n, r1, r3, r5), or none; ``examples``: (detector,
    outcome, case_id, category, note, attribution, rule_id, verdict, confidence, violated_clause, counterexample)."""

    dataset: DataFrame
    names: DataFrame
    overall: DataFrame
    categories: DataFrame
    attribution: DataFrame
    examples: DataFrame
    retrieval: DataFrame | None = None


@dataclass
class Section:
    title: str
    words: list[str] = field(default_factory=list)
    header: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    points: list[str] = field(default_factory=list)
    level: int = 2


def collected(frame: DataFrame) -> list[dict]:
    rows = frame.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a frame of a report has more than {MOST_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def percent(value: float | None) -> str:
    return "-" if value is None else f"{100 * value:.0f}%"


def number(value: float | None) -> str:
    return "-" if value is None else f"{value:.2f}"


def sections(frames: Frames) -> list[Section]:
    names = sorted(collected(frames.names), key=lambda r: r["ord"])
    by_level: dict[str, list[dict]] = {}
    for row in collected(frames.dataset):
        by_level.setdefault(row["level"], []).append(row)
    counts = {r["category"]: r for r in by_level.get("category", []) if r["valid"]}
    sums = lambda flag, what: sum(counts[n["category"]][what] for n in names if n["is_drift"] == flag and n["category"] in counts)
    drift, negatives = sums(True, "valid"), sums(False, "valid")
    projects = ", ".join(sorted(r["project"] for r in by_level.get("project", []) if r["valid"]))
    share = lambda r: f"{r['escaped']}/{r['valid']} ({percent(r['escaped'] / r['valid'])})"
    dataset = Section("Dataset", [f"{drift + negatives} valid cases of {projects or 'no project'}: {drift} drift, {negatives} negative controls."])
    dataset.words.append(f"{percent(sums(True, 'escaped') / drift if drift else 0.0)} of the drift cases still pass their project's own tests.")
    dataset.header = ["Cat", "Category", "n", "Passes tests"]
    dataset.rows = [[n["category"], n["name"], str(counts[n["category"]]["valid"]), share(counts[n["category"]])] for n in names if n["category"] in counts]

    overall = sorted(collected(frames.overall), key=lambda r: r["detector"])
    detectors = [r["detector"] for r in overall]
    compared = Section("Detector comparison", header=["Detector", "Model", "Precision", "Recall", "F1", "False-alarm rate", "Uncertain", "Questions"])
    for r in overall:
        rates = [number(r[c]) for c in ("precision", "recall", "f1", "false_alarm_rate", "uncertain_rate")]
        compared.rows.append([r["detector"], r["model"] or "n/a", *rates, "-" if r["asked"] is None else str(r["asked"])])

    values = {(r["detector"], r["category"]): r for r in collected(frames.categories)}
    each = Section("Per category", ["D rows are recall, N rows the false-alarm rate on controls."], ["Cat", "Category", "n", *detectors])
    for n in names:
        held = [values.get((d, n["category"])) for d in detectors]
        size = next((v["n"] for v in reversed(held) if v), 0)
        each.rows.append([n["category"], n["name"], str(size), *[percent(v["value"] if v else None) for v in held]])
    out = [dataset, compared, each]

    if frames.retrieval is not None:
        ranked = sorted(collected(frames.retrieval), key=lambda r: (r["category"] == "all", r["category"]))
        rows = [[r["category"], str(r["n"]), *[percent(r[c]) for c in ("r1", "r3", "r5")]] for r in ranked]
        out.append(Section("Retrieval", header=["Cat", "n", "R@1", "R@3", "R@5"], rows=rows))
    missed = {(r["detector"], r["attribution"]): r["n"] for r in collected(frames.attribution)}
    rows = [[d, *[str(missed.get((d, a), 0)) for a in ATTRIBUTIONS]] for d in detectors]
    out.append(Section("Why drift was missed", header=["Detector", "Retrieval", "Reasoning", "n/a"], rows=rows))

    out.append(Section("Example verdicts"))
    order = {o: k for k, o in enumerate(SHOWN)}
    for r in sorted(collected(frames.examples), key=lambda r: (r["detector"], order[r["outcome"]])):
        one = Section(f"{r['detector']}: {SHOWN[r['outcome']]} ({r['case_id']}, {r['category']})", [r["note"]] if r["note"] else [], level=3)
        one.points.append(f"Rule {r['rule_id']}: {r['verdict']} (confidence {number(r['confidence'])})")
        shown = r["counterexample"] or {}
        if r["attribution"]:
            one.points.append(f"Missed via: {r['attribution']}")
        if r["violated_clause"]:
            one.points.append(f"Clause: {r['violated_clause']}")
        if shown.get("input"):
            one.points.append(f"Counterexample: given {shown['input']}, expected {shown['expected']}, actual {shown['actual']}")
        out.append(one)
    return out


def markdown(parts: list[Section], title: str) -> str:
    cell = lambda text: text.replace("|", "\\|").replace("\n", " ")
    line = lambda cells: "| " + " | ".join(map(cell, cells)) + " |"
    lines = [f"# {title}", ""]
    for part in parts:
        lines += ["#" * part.level + f" {part.title}", ""]
        lines += [x for words in part.words for x in (words, "")]
        if part.header:
            lines += [line(part.header), line(["---"] * len(part.header)), *map(line, part.rows), ""]
        if part.points:
            lines += [*[f"- {point}" for point in part.points], ""]
    return "\n".join(lines).rstrip() + "\n"


def page(parts: list[Section], title: str) -> str:
    safe, out = html.escape, []
    out += ["<!doctype html>", f"<html lang='en'><head><meta charset='utf-8'><title>{safe(title)}</title></head><body>", f"<h1>{safe(title)}</h1>"]
    for part in parts:
        out.append(f"<h{part.level}>{safe(part.title)}</h{part.level}>")
        out += [f"<p>{safe(words)}</p>" for words in part.words]
        if part.header:
            row = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{safe(c)}</{tag}>" for c in cells) + "</tr>"
            out += ["<table>", row("th", part.header), *[row("td", r) for r in part.rows], "</table>"]
        if part.points:
            out += ["<ul>", *[f"<li>{safe(point)}</li>" for point in part.points], "</ul>"]
    return "\n".join([*out, "</body></html>"]) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file in any store that Spark reaches; the old one stays until the new one is whole."""
    jvm = spark._jvm
    place, draft = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new"))
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = files.create(draft, True)
    out.write(text.encode())
    out.close()
    files.delete(place, False)
    files.rename(draft, place)


def write_report(spark: SparkSession, frames: Frames, folder: str, title: str = "Conformance report") -> None:
    parts = sections(frames)
    write_text(spark, f"{folder}/report.md", markdown(parts, title))
    write_text(spark, f"{folder}/report.html", page(parts, title))

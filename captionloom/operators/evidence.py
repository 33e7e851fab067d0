"""Frame evidence: sampled frames of a source and of its burned output in pairs, and what the manifest asks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.functions.text import finite

#: The part of a frame above which overlays do not stand, and from where on a channel's difference counts.
ABOVE, LEAST = 0.45, 25
MINIMUM_RATIO = 0.002

RECORD = "array<struct<path: string, sha256: string>>"


def difference_ratios(pairs: DataFrame) -> DataFrame:
    """pairs of pictures with `ratio`: the share of channel values in the lower part that differ by LEAST or more.

    `pairs` has (job_id, ordinal, width, height, source, width2, height2, burned), pictures as rows of RGB
    bytes. Pictures of other sizes, or whose bytes are not width x height x 3, have a null ratio; pictures
    without a lower part have 0. One Arrow stage, a picture at a time.
    """

    def run(batches):
        for b in batches:
            out = []
            for w, h, a, w2, h2, c in zip(*[b.column(k).to_pylist() for k in range(2, 8)], strict=True):
                if None in (w, h, a, c) or (w, h) != (w2, h2) or w < 0 or h < 0 or len(a) != w * h * 3 or len(c) != len(a):
                    out.append(None)
                    continue
                first = int(h * ABOVE) * w * 3
                x, y = (np.frombuffer(v, np.uint8)[first:].astype(np.int16) for v in (a, c))
                out.append(float((np.abs(x - y) >= LEAST).mean()) if len(x) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["job_id", "ordinal", "ratio"])

    wanted = pairs.select("job_id", "ordinal", *[F.col(c).cast("int").alias(c) if c[0] in "wh" else F.col(c) for c in ("width", "height", "source", "width2", "height2", "burned")])
    return wanted.mapInArrow(run, f"job_id {pairs.schema['job_id'].dataType.simpleString()}, ordinal {pairs.schema['ordinal'].dataType.simpleString()}, ratio double")


def compare_frames(source: DataFrame, burned: DataFrame) -> DataFrame:
    """(job_id, ordinal, ratio) of frames (job_id, ordinal, width, height, pixels) paired by place; see difference_ratios()."""
    b = burned.select("job_id", "ordinal", F.col("width").alias("width2"), F.col("height").alias("height2"), F.col("pixels").alias("burned"))
    return difference_ratios(source.withColumnRenamed("pixels", "source").join(b, ["job_id", "ordinal"]))


def frame_gate(jobs: DataFrame, source: DataFrame, burned: DataFrame, minimum: float = MINIMUM_RATIO) -> DataFrame:
    """(job_id, rule) violations of the overlay gate for each of jobs (job_id); a job of sound frames has none.

    Both sides must have frames, as many, at the same places and none of them empty; sizes must agree; each ratio
    must reach the minimum. Without a ratio there is no overlay evidence either. Null pixels are empty;
    repeated places count as frames of their own and make the sampling invalid; jobs that `jobs` lacks are left out.
    """
    stat = lambda d, n: d.groupBy("job_id").agg(F.count("*").alias(f"n_{n}"), F.countDistinct("ordinal").alias(f"d_{n}"), F.count_if(F.coalesce(F.octet_length("pixels"), F.lit(0)) == 0).alias(f"e_{n}"))
    paired = compare_frames(source, burned).groupBy("job_id").agg(F.count("*").alias("n"), F.count("ratio").alias("n_ratio"), F.min("ratio").alias("least"))
    all_ = jobs.select("job_id").distinct().join(stat(source, "a"), "job_id", "left").join(stat(burned, "b"), "job_id", "left").join(paired, "job_id", "left").na.fill(0, ["n_a", "n_b", "d_a", "d_b", "e_a", "e_b", "n", "n_ratio"])
    sampled = (F.col("n_a") > 0) & (F.col("n_a") == F.col("n_b")) & (F.col("n") == F.col("n_a")) & (F.col("d_a") == F.col("n_a")) & (F.col("d_b") == F.col("n_b")) & (F.col("e_a") + F.col("e_b") == 0)
    compared = F.col("n_ratio") == F.col("n")
    rules = [
        F.when(~sampled, F.lit("cue frame sampling failed")),
        F.when(sampled & ~compared, F.lit("sampled frame comparison failed")),
        F.when(~(sampled & compared) | (F.col("least") < minimum), F.lit("burned cue frames lack visible overlay evidence")),
    ]
    return all_.select("job_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def manifest_evidence(reports: DataFrame, files: DataFrame, minimum: float = MINIMUM_RATIO) -> DataFrame:
    """(job_id, field, place, rule): what is wrong with the frame lists of validation reports.

    `reports` has (job_id, content), JSON with sampled_frames and source_sampled_frames (path and sha256 of
    each frame) and burned_lower_frame_difference_ratio; `files` has (job_id, path, sha256) on hand. Each
    list must hold records whose files are there unchanged; the ratios must be as many as the frames of
    either list, finite numbers (JSON's NaN is none), and reach the minimum. Ragged lists are compared by place. A report that
    is no JSON object, or null, has no lists. `place` is null for what concerns a whole list.
    """
    # Values that have another type than asked for are null, and a list that is none is a null list.
    shape = "struct<sampled_frames: array<string>, source_sampled_frames: array<string>, burned_lower_frame_difference_ratio: array<string>>"
    r = reports.select("job_id", F.from_json("content", shape).alias("r")).select("job_id", "r.*")
    names, ratios = ("sampled_frames", "source_sampled_frames"), "burned_lower_frame_difference_ratio"
    rows = []
    for name in names:
        rows.append(r.filter(F.coalesce(F.size(name), F.lit(0)) <= 0).select("job_id", F.lit(name).alias("field"), F.lit(None).cast("int").alias("place"), F.lit("no frames").alias("rule")))
    listed = [r.select("job_id", F.lit(name).alias("field"), F.posexplode(name).alias("place", "record")) for name in names]
    frames = listed[0].unionByName(listed[1])
    frames = frames.select("job_id", "field", "place", F.from_json("record", "struct<path: string, sha256: string>").alias("f")).select("job_id", "field", "place", "f.path", F.col("f.sha256").alias("wanted"))
    checked = frames.join(files.select("job_id", "path", F.col("sha256").alias("have")), ["job_id", "path"], "left")
    wrong = F.when(F.col("path").isNull(), "no record").when(F.col("have").isNull(), "file missing").when(~F.col("wanted").eqNullSafe(F.col("have")), "file changed")
    rows.append(checked.select("job_id", "field", F.col("place").cast("int").alias("place"), wrong.alias("rule")).filter("rule is not null"))
    uneven = F.col(ratios).isNull() | (F.size(ratios) != F.coalesce(F.size(names[0]), F.lit(0))) | (F.size(ratios) != F.coalesce(F.size(names[1]), F.lit(0)))
    rows.append(r.filter(uneven).select("job_id", F.lit(ratios).alias("field"), F.lit(None).cast("int").alias("place"), F.lit("not as many as frames").alias("rule")))
    number = F.col("value").try_cast("double")
    low = F.when(number.isNull(), "no number").when(~finite(number), "not finite").when(number < minimum, "below minimum")
    rows.append(r.select("job_id", F.posexplode(ratios).alias("place", "value")).select("job_id", F.lit(ratios).alias("field"), F.col("place").cast("int").alias("place"), low.alias("rule")).filter("rule is not null"))
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out


#: The artifacts that a finished job must have, one of the soft outputs, and the reports that must pass.
REQUIRED = ("source/discovery.json", "transcript/pt-BR.raw.json", "translation/en.json", "subtitles/en.srt", "subtitles/en.vtt", "output/burned-in.mp4", "validation/report.json")
PASSING = ("asr/evaluation.json", "transcript/validation.json", "translation/validation.json", "subtitles/validation.json")


def manifest_contract(jobs: DataFrame, files: DataFrame, reports: DataFrame, source_patterns: tuple[str, ...] = ("source/source.*",), soft_patterns: tuple[str, ...] = ("output/soft-subtitled.*",), passing: tuple[str, ...] = PASSING, minimum: float = MINIMUM_RATIO) -> DataFrame:
    """(job_id, code, field, place, rule): every breach of the manifest's contract; a job of no row is complete.

    `files` (job_id, path, sha256) are on hand; `reports` (job_id, path, content) hold the JSON reports. The
    validation report's quality_status and the other reports' status must be PASS (QUALITY_NOT_PASSING),
    frame lists sound (VALIDATION_EVIDENCE_INVALID, see manifest_evidence()), required paths there and exactly one
    file for each of the patterns (COMPLETION_ARTIFACT_MISSING). In a pattern a star stands for any
    characters but a slash.
    """
    jobs = jobs.select("job_id").distinct()
    final = "validation/report.json"
    own = jobs.join(reports.filter(F.col("path") == final).select("job_id", "content"), "job_id", "left")
    wanted = jobs.select("job_id", F.explode(F.array(*[F.lit(p) for p in (final, *passing)])).alias("path")).join(reports.select("job_id", "path", "content"), ["job_id", "path"], "left")
    told = F.from_json("content", "struct<quality_status: string, status: string>")
    status = F.when(F.col("path") == final, told["quality_status"]).otherwise(told["status"])
    none = F.lit(None).cast("int").alias("place")
    quality = wanted.filter(~F.coalesce(status == "PASS", F.lit(False))).select("job_id", F.lit("QUALITY_NOT_PASSING").alias("code"), F.col("path").alias("field"), none, F.lit("not passing").alias("rule"))
    frames = manifest_evidence(own, files, minimum).select("job_id", F.lit("VALIDATION_EVIDENCE_INVALID").alias("code"), "field", "place", "rule")
    have = files.select("job_id", "path").distinct()
    paths = jobs.select("job_id", F.explode(F.array(*[F.lit(p) for p in dict.fromkeys((*REQUIRED, *passing))])).alias("path"))
    absent = paths.join(have, ["job_id", "path"], "left_anti").select("job_id", F.lit("COMPLETION_ARTIFACT_MISSING").alias("code"), F.col("path").alias("field"), none, F.lit("missing").alias("rule"))
    out = quality.union(frames).union(absent)
    for pattern in (*source_patterns, *soft_patterns):
        like = "^" + "[^/]*".join(_quoted(x) for x in pattern.split("*")) + "$"
        n = jobs.join(have.filter(F.col("path").rlike(like)).groupBy("job_id").agg(F.count("*").alias("n")), "job_id", "left")
        rule = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "more than one")
        out = out.union(n.select("job_id", F.lit("COMPLETION_ARTIFACT_MISSING").alias("code"), F.lit(pattern).alias("field"), none, rule.alias("rule")).filter("rule is not null"))
    return out


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in text)

"""python -m quillstone.cli FILE OUT [--target COLUMN]: load, profile, detect, plan, clean, report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quillstone.operators import checks, evidence, features, profile, repair, report, rules
from quillstone.plans import planner
from quillstone.sources import reader, sinks


def main(argv: list[str] | None = None) -> str:
    arguments = argparse.ArgumentParser(description=__doc__)
    arguments.add_argument("file")
    arguments.add_argument("out")
    arguments.add_argument("--target")
    arguments.add_argument("--no-header", action="store_true")
    arguments.add_argument("--evidence", action="store_true")
    a = arguments.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    loaded = reader.read_table(spark, a.file, has_header=not a.no_header)
    frame = loaded.frame.cache()
    profiles = profile.profile_frame(frame)
    found = checks.detect(frame, profiles, target=a.target)
    plan = planner.build(found, target=a.target)
    done = repair.run(frame, plan, target=a.target)
    made = features.build(done.train, done.test, profile.profile_frame(done.train), target=done.target)
    checked = rules.validate(frame, rules.infer_rules(frame, profiles, target=a.target))
    for name, table in (("clean-train", done.train), ("clean-test", done.test), ("features-train", made.train), ("features-test", made.test), ("quarantine", checked.rejected)):
        sinks.write_csv(table, f"{a.out}/{name}")
    swept = evidence.sweep(frame, a.target) if a.evidence and a.target else None
    text = report.build(loaded, found, plan, cleaned=done, validation=checked, features=made, evidence=swept)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/report")
    return text


if __name__ == "__main__":
    main()

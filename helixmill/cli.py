"""Command line: impute, normalise, align and fuse two delimited tables and write the result."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from helixmill.config import Config
from helixmill.operators import learn
from helixmill.plans.pipeline import pipeline_options, run_checked
from helixmill.session import local_session
from helixmill.sources import exports, readers


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="helixmill", description=__doc__)
    p.add_argument("--omic", required=True)
    p.add_argument("--clinical", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--key", default="patient_id")
    p.add_argument("--config")
    p.add_argument("--format", choices=["csv", "json", "jsonl", "parquet", "ml"], default=None, help="else the configuration's export.format")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    config = Config.from_yaml(a.config) if a.config else Config()
    spark = local_session()
    omic, clinical = readers.read_csv(spark, a.omic), readers.read_csv(spark, a.clinical)
    out = run_checked(omic, clinical, a.key, **pipeline_options(config))
    if out["status"] != "success":
        logging.error("%s", out["error"])
        return 1
    data = out.pop("data")
    write = {"csv": lambda: exports.write_csv(data, a.output, sep=config.get("export.sep"), metadata={"key": a.key}), "json": lambda: exports.write_json(data, a.output, schema=True), "jsonl": lambda: exports.write_json_lines(data, a.output), "parquet": lambda: exports.write_parquet(data, a.output), "ml": lambda: exports.write_learning_set(learn.stratified_split(data, a.key, config.get("export.target"), config.get("export.test_size")), a.output, a.key, config.get("export.target"))}
    write[a.format or config.get("export.format")]()
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())

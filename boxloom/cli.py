"""The command line: ``python -m boxloom COMMAND``, or the same through spark-submit.

    config validate|show SETTINGS          check settings and what they need, or print them with their defaults
    compile SETTINGS                       compile a dataset
    predict SETTINGS --model MODULE:NAME   predict a split; NAME makes the model (a ModelFactory)
    batch SETTINGS --model MODULE:NAME     run a manifest
    detect SETTINGS --model MODULE:NAME    answer one request (--width and --height of its target image)
    evaluate SETTINGS                      score predictions and publish a report
    artifact init SETTINGS --topology FILE
    artifact inspect FOLDER --contract FILE --topology FILE
    accept PROFILE OUTPUT EVIDENCE...      assemble a report over the gates

Settings end in .json, .yaml or .yml. Exit codes: 0 done, 1 failed (or not
accepted, or a task of a batch failed), 2 refused.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import uuid
from typing import Any

from pyspark.sql import SparkSession

from boxloom.errors import BoxloomError, ConfigError, exit_code
from boxloom.plans import artifacts, gates, predict, sinks
from boxloom.plans.compile import compile_dataset, open_dataset
from boxloom.plans.evaluate import evaluate
from boxloom.sources import config as C
from boxloom.sources import files, requests, resources


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="boxloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    settings = commands.add_parser("config")
    settings.add_argument("operation", choices=("validate", "show"))
    settings.add_argument("settings")
    for name in ("compile", "evaluate"):
        commands.add_parser(name).add_argument("settings")
    for name in ("predict", "batch", "detect"):
        one = commands.add_parser(name)
        one.add_argument("settings")
        one.add_argument("--model", required=True)
        if name == "detect":
            one.add_argument("--width", type=int, required=True)
            one.add_argument("--height", type=int, required=True)
    artifact = commands.add_parser("artifact").add_subparsers(dest="operation", required=True)
    init, inspect = artifact.add_parser("init"), artifact.add_parser("inspect")
    init.add_argument("settings")
    inspect.add_argument("folder")
    inspect.add_argument("--contract", required=True)
    for one in (init, inspect):
        one.add_argument("--topology", required=True)
    accept = commands.add_parser("accept")
    accept.add_argument("profile", choices=sorted(gates.MANDATORY))
    accept.add_argument("output")
    accept.add_argument("evidence", nargs="*")
    return parser


def _settings(spark: SparkSession, path: str, kind: type | None = None) -> Any:
    if not sinks.exists(spark, path):
        raise ConfigError(f"{path} does not exist")
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    found = C.load(text, yaml=path.endswith((".yaml", ".yml")))
    if kind is not None and not isinstance(found, kind):
        raise ConfigError(f"{path} is of kind {C.kind_of(found)}")
    return found


def _model(name: str) -> predict.ModelFactory:
    module, _, attribute = name.partition(":")
    try:
        return getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError, ValueError) as e:
        raise ConfigError(f"no model {name}: {e}") from None


def _topology(spark: SparkSession, path: str) -> artifacts.Topology:
    told = sinks.read_document(spark, path)
    if not isinstance(told, dict) or not isinstance(told.get("values"), dict) or not isinstance(told.get("modules"), list):
        raise ConfigError(f"{path} lacks values or modules")
    return artifacts.Topology(told["values"], frozenset(told["modules"]))


def _say(value: dict[str, Any]) -> None:
    print(json.dumps(value, ensure_ascii=False))


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "config":
        config = _settings(spark, args.settings)
        if args.operation == "validate":
            resources.check(spark, config)
            _say({"kind": C.kind_of(config), "config_hash": C.config_hash(config)})
        else:
            _say(C.as_mapping(config))
    elif args.command == "compile":
        config = _settings(spark, args.settings, C.CompileConfig)
        resources.check(spark, config)
        _say({"dataset": compile_dataset(spark, config)})
    elif args.command == "evaluate":
        config = _settings(spark, args.settings, C.EvaluateConfig)
        resources.check(spark, config)
        made = evaluate(spark, files.records(spark, config.records, config.split), files.predictions(spark, config.predictions), config.output, {"config_hash": C.config_hash(config)})
        _say({"evaluation": config.output, "evaluation_fingerprint": made["evaluation_fingerprint"], "slices": made["slices"]})
    elif args.command == "predict":
        config = _settings(spark, args.settings, C.PredictConfig)
        resources.check(spark, config)
        folders = sinks.read_document(spark, f"{config.dataset}/manifest.json").get("sources", {})
        rows = open_dataset(spark, config.dataset)[config.split]
        made = predict.predict(requests.require(requests.from_records(rows, folders)), _model(args.model))
        with sinks.publish(spark, config.predictions) as folder:
            sinks.write_lines(made, folder)
        _say({"predictions": config.predictions, "records": files.predictions(spark, config.predictions).count()})
    elif args.command == "batch":
        config = _settings(spark, args.settings, C.BatchConfig)
        tasks = files.manifest(spark, config.manifest)
        done = None if config.overwrite else predict.finished(spark, f"{config.output}/outputs")
        found = predict.kept(predict.batch(tasks, _model(args.model), done))
        predict.write_outputs(found, tasks, f"{config.output}/outputs")
        with sinks.publish(spark, f"{config.output}/results-{C.config_hash(config)[:12]}-{uuid.uuid4().hex[:12]}") as folder:
            predict.write_results(predict.result_lines(found, tasks, f"{config.output}/outputs"), folder)
        failed = found.where("status = 'failed'").count()
        _say({"output": config.output, "failed": failed})
        return 1 if failed else 0
    elif args.command == "detect":
        config = _settings(spark, args.settings, C.DetectConfig)
        resources.check(spark, config)
        request = {"reference_image": config.request.reference_image, "reference_boxes": [list(b) for b in config.request.reference_boxes], "target_image": config.request.target_image, "query": config.request.query.strip()}
        made = predict.detect(_model(args.model)(), request, args.width, args.height) | {"config_hash": C.config_hash(config)}
        sinks.write_document(spark, config.output, made)
        print(made["detection_set"])
    elif args.command == "artifact" and args.operation == "init":
        config = _settings(spark, args.settings, C.ArtifactConfig)
        resources.check(spark, config)
        contract, topology = sinks.read_document(spark, config.contract), _topology(spark, args.topology)
        above = artifacts.unseal(spark, config.parent_artifact, contract, topology).seal if config.parent_artifact else None
        card = {"stage": config.stage, "from": config.source_adapter, "parent": above, "config_hash": C.config_hash(config)}
        made = artifacts.seal(spark, config.source_adapter, config.output, artifacts.verify_contract(contract, contract), topology, card)
        _say({"artifact": made.path, "seal": made.seal})
    elif args.command == "artifact":
        made = artifacts.unseal(spark, args.folder, sinks.read_document(spark, args.contract), _topology(spark, args.topology))
        _say({"path": made.path, "seal": made.seal, "card": made.card})
    else:
        made = gates.assemble(spark, args.profile, args.evidence, args.output)
        _say({"report": args.output, "accepted": made["accepted"]})
        return 0 if made["accepted"] else 1
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        return _run(spark, args)
    except (BoxloomError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return exit_code(e)

"""Build the warehouse from ticket files: ``spark-submit ticketlens/run.py --help``."""

from __future__ import annotations

import argparse
from importlib import import_module

from pyspark import cloudpickle

from ticketlens.operators.batching import BATCH_SIZE
from ticketlens.plans.warehouse import Warehouse
from ticketlens.session import build_session


def load(path: str):
    """The object that ``package.module:name`` names, ready to be sent to executors."""
    name, _, attribute = path.partition(":")
    module = import_module(name)
    cloudpickle.register_pickle_by_value(module)
    return getattr(module, attribute)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Label tickets and build the ticket tables.")
    parser.add_argument("tickets", help="folder or glob of ticket CSV files")
    parser.add_argument("--labeler", required=True, help="package.module:name of a labeller")
    parser.add_argument("--writer", help="package.module:name of a narrative writer")
    parser.add_argument("--location", help="folder for the tables; the session's warehouse if left out")
    parser.add_argument("--concurrency", type=int, help="partitions, and so parallel labeller calls")
    parser.add_argument("--single-line", action="store_true", help="no field spans lines: split large files")
    parser.add_argument("--lenient", action="store_true", help="store rows that cannot be cast apart instead of failing")
    parser.add_argument("--resume", action="store_true", help="keep stored labels, ask for what lacks one")
    parser.add_argument("--steps", type=int, default=1, help="parts whose labels are stored one by one")
    parser.add_argument("--batch-size", type=int, default=BATCH_SIZE, help="tickets per labeller call")
    parser.add_argument("--stable-batches", action="store_true", help="batches by ticket id, whatever the files")
    args = parser.parse_args(argv)

    house = Warehouse(build_session(), args.location)
    tickets = house.read_tickets(args.tickets, multi_line=not args.single_line)
    report = house.load_labelled(
        tickets,
        load(args.labeler),
        resume=args.resume,
        steps=args.steps,
        concurrency=args.concurrency,
        batch_size=args.batch_size,
        stable_batches=args.stable_batches,
    )
    print(report)
    if args.writer:
        house.tell(load(args.writer), args.lenient)
    for name, rows in house.build_models(args.lenient).items():
        print(f"{name}: {rows} rows")


if __name__ == "__main__":
    main()

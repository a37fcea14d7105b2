"""Command line: build a project graph from a folder of documents, or list and run a query."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

#: A small graph to try the export with.
INVENTED = """{"entities": [{"id": "e1", "type": "kg:Company", "name": "Acme"}, {"id": "e2", "type": "kg:Person", "fullName": "Ann Lee", "roles": ["chair", "founder"]}],
"relationships": [{"source": "e1", "target": "e2", "type": "kg:ledBy"}]}"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kgloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="documents to a project graph")
    build.add_argument("folder")
    build.add_argument("out")
    build.add_argument("--pattern", default="*.txt")
    build.add_argument("--client", default="rules")
    build.add_argument("--ontology", help="YAML file; without it, no ontology is used and nothing is scored")
    build.add_argument("--units", choices=("pages", "chunks"), default="pages")
    build.add_argument("--rules", choices=("threshold", "strategy"), default="threshold")
    build.add_argument("--construction", choices=("parallel", "iterative"), default="parallel")
    build.add_argument("--diagnostics", action="store_true", help="write and print the merge report")
    build.add_argument("--export", action="store_true", help="write meta, nodes and links as JSON arrays")
    build.add_argument("--dumps", action="store_true", help="write the graph of each unit")
    build.add_argument("--categories", default="report,contract,financial_teaser")
    build.add_argument("--max-size", type=int, default=4000)
    build.add_argument("--min-size", type=int, default=500)
    build.add_argument("--overlap", type=int, default=200)
    export = sub.add_parser("export", help="graph files (JSON) to meta, nodes and links; without --graphs, an invented graph")
    export.add_argument("out")
    export.add_argument("--graphs")
    export.add_argument("--ontology")
    export.add_argument("--model", default="rules")
    export.add_argument("--provider", default="local")
    query = sub.add_parser("query", help="run a registered query over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("out")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kgloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "query":
        from kgloom.plans.registry import QUERIES

        QUERIES[args.name](spark, args.folder).write.mode("overwrite").parquet(args.out)
        return
    from kgloom.operators.chunk import ChunkConfig
    from kgloom.operators.ontology import Ontology
    from kgloom.plans.project import Project, run_folder

    onto = Ontology.load(args.ontology) if args.ontology else None
    if args.command == "export":
        from kgloom.plans.project import document_graphs, export_files, project_graph
        from kgloom.sources.files import read_graphs, url

        graphs = read_graphs(spark, args.graphs) if args.graphs else spark.createDataFrame([("invented", 1, INVENTED)], "doc string, page int, graph_json string")
        project = Project(ontology=onto, model=args.model, provider=args.provider)
        export_files(*project_graph(*document_graphs(graphs, project)), url(args.out), project)
        return
    project = Project(
        args.client, tuple(args.categories.split(",")), onto, args.units, ChunkConfig(args.max_size, args.min_size, args.overlap), args.rules, args.construction, args.diagnostics, args.export, args.dumps, model=args.client
    )
    run_folder(spark, args.folder, args.out, project, args.pattern)


if __name__ == "__main__":
    main()

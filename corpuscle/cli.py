"""Command line: chunk, bm25, search, eval, viz, parse, stats, export."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from corpuscle.functions import italian as it
from corpuscle.operators import analysis, documents, export, parse, search, state
from corpuscle.session import get_spark
from corpuscle.sources import tables


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="corpuscle", description=__doc__)
    sub = top.add_subparsers(dest="cmd", required=True)
    new = lambda name, text: sub.add_parser(name, help=text)
    p = new("chunk", "select documents, find families, mine wording, cut chunks")
    p.add_argument("--n", type=int, default=None, help="number of newest documents")
    new("bm25", "write the keyword index")
    p = new("search", "search with the queries of a table")
    p.add_argument("-k", type=int, default=5)
    p.add_argument("--alpha", type=float, default=it.HYBRID_ALPHA)
    p.add_argument("--no-weights", action="store_true")
    p.add_argument("--sections", choices=["violation", "activity"], default=None)
    p.add_argument("--years", type=int, nargs=2, default=None)
    p.add_argument("--types", nargs="+", default=None)
    p.add_argument("--index", default=None, help="folder that bm25 wrote")
    p = new("eval", "precision and reciprocal rank by language")
    p.add_argument("--alpha", type=float, nargs="+", default=[it.HYBRID_ALPHA])
    p.add_argument("--no-weights", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p = new("viz", "figures of the embedding map")
    p.add_argument("--sections", choices=["violation", "activity"], default=None)
    p = new("parse", "parse fetched pages")
    p.add_argument("--pages", required=True)
    p = new("queue", "documents to be fetched")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--random", action="store_true")
    new("stats", "figures of the corpus")
    p = new("export", "write the export tables")
    p.add_argument("--dry-run", action="store_true")
    for p in sub.choices.values():
        p.add_argument("--data", required=True, help="folder of the parquet tables")
        p.add_argument("--out", default=None, help="folder for results; shown if not given")
    a = top.parse_args(argv)
    spark = get_spark()
    t = lambda name: tables.table(spark, a.data, name)

    def give(df, name):
        if a.out:
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
        else:
            df.show(50, truncate=60)

    if a.cmd == "chunk":
        chunks, twins, figures = documents.build_index(t("docs"), a.n)
        give(chunks, "chunks"), give(twins, "duplicates"), give(figures, "figures")
    elif a.cmd == "bm25":
        print(search.write_index(t("chunks"), f"{a.out or a.data}/bm25"))
    elif a.cmd == "search":
        give(search.search(t("chunks"), t("queries"), a.k, a.alpha, not a.no_weights, a.sections, tuple(a.years) if a.years else None, a.types, postings=search.read_index(t("chunks"), a.index) if a.index else None).orderBy("query_id", "rank"), "results")
    elif a.cmd == "eval":
        for alpha in a.alpha:
            per = search.evaluate(search.search(t("chunks"), t("queries"), alpha=alpha, weighted=not a.no_weights), t("chunks"), t("queries"))
            if a.verbose:
                give(per, f"eval-{alpha:g}-queries")
            give(search.evaluation_summary(per).withColumn("alpha", F.lit(alpha)), f"eval-{alpha:g}")
    elif a.cmd == "viz":
        from corpuscle.functions import columns as C

        chunks = t("chunks").where(C.in_scope(a.sections, F.col("section"), F.col("tipologia")))
        v = analysis.doc_vectors(chunks)
        edges = analysis.without_procedural(analysis.citation_edges(t("docs"), v, t("duplicates")), t("docs"))
        xy, var = analysis.pca_2d(v)
        give(xy, "map"), give(var, "variance"), give(analysis.graph_figures(v, edges), "closeness")
    elif a.cmd == "parse":
        parsed = parse.parse_documents(tables.read_pages(spark, a.pages), state.current_state(t("docs_state")))
        give(parsed.where("error is null").drop("error"), "docs"), give(parse.parse_report(parsed), "report")
    elif a.cmd == "queue":
        give(state.work_queue(state.current_state(t("docs_state")), a.limit, a.random), "queue")
    elif a.cmd == "stats":
        d = t("docs")
        give(analysis.corpus_figures(d), "figures"), give(analysis.by_year(d), "years"), give(analysis.counts_by(d, "argomenti", 40), "topics"), give(analysis.counts_by(d, "tipologia"), "types")
    else:
        gone = export.missing_documents(t("docs"), t("chunks")).count()
        print(f"{gone} documents of chunks are missing")
        if not a.dry_run:
            give(export.decisions(t("docs"), t("chunks"), t("duplicates")), "decisions"), give(export.chunk_rows(t("chunks")), "chunk_rows"), give(export.lexeme_stats(t("chunks")), "lexeme_stats")


if __name__ == "__main__":
    main()

"""Command line: ``index``, ``query`` and ``debug-chunks``."""

from __future__ import annotations

import argparse

from corpusmill.functions import dates
from corpusmill.functions import fixed_values as fv
from corpusmill.operators.chunking import ChunkPlan
from corpusmill.operators.embedding import HashEmbedder
from corpusmill.plans import ask, index_job
from corpusmill.session import local_session
from corpusmill.sources.files import read_corpus, require_documents


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corpusmill")
    commands = parser.add_subparsers(dest="command", required=True)
    corpus = argparse.ArgumentParser(add_help=False)
    corpus.add_argument("--corpus", required=True)
    corpus.add_argument("--max-file-bytes", type=int, default=None)
    corpus.add_argument("--chunk-size", type=int, default=fv.CHUNK_SIZE)
    corpus.add_argument("--chunk-overlap", type=float, default=fv.CHUNK_OVERLAP)
    index = commands.add_parser("index", parents=[corpus])
    index.add_argument("--store", required=True)
    debug = commands.add_parser("debug-chunks", parents=[corpus])
    debug.add_argument("--sample", type=int, default=3)
    debug.add_argument("--top-docs", type=int, default=5)
    query = commands.add_parser("query")
    query.add_argument("--store", required=True)
    query.add_argument("--q", required=True)
    query.add_argument("--lang", default=fv.DEFAULT_LANGUAGE)
    query.add_argument("--top-k", type=int, default=fv.TOP_K)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = local_session()
    if args.command == "query":
        chunks = index_job.search_chunks(index_job.Store(spark, args.store))
        hits, answer = ask.ask(args.q, chunks, HashEmbedder(), args.lang, args.top_k)
        hits.select("rank", "score", "source_path", "title", "lang").show(args.top_k, truncate=60)
        answer.show(1, truncate=False, vertical=True)
        return
    as_of = dates.moment(None)
    plan = ChunkPlan(args.chunk_size, args.chunk_overlap)
    docs = require_documents(read_corpus(spark, args.corpus, as_of, args.max_file_bytes))
    if args.command == "index":
        store = index_job.Store(spark, args.store)
        print(index_job.run_index(docs, store, as_of, index_job.IndexSettings(plan=plan)))
        return
    report = ask.chunk_report(docs, plan, args.sample, args.top_docs)
    for frame in (report.totals, report.by_language, report.by_source, report.top_documents, report.sample):
        frame.show(50, truncate=80)


if __name__ == "__main__":
    main()

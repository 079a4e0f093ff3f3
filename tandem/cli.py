"""python -m tandem STORE preprocess|resolve_urls|compute|export_network|export_user_nodes ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions import text
from .operators import links, outputs
from .operators.graph import NETWORKS
from .plans import networks
from .sources import messages
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tandem", description="Networks of accounts that act together.")
    top.add_argument("store", help="folder of the message store")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("preprocess", help="add message files")
    p.add_argument("files", nargs="+")
    p.add_argument("--format", choices=("csv", "twitter_json", "twitter_v2_likes_retweets"), default="csv")
    p.add_argument("--drop_empty_urls", action="store_true")
    p = sub.add_parser("resolve_urls", help="follow the redirects of links")
    p.add_argument("--max_redirects", type=int, default=1)

    def exported(p: argparse.ArgumentParser, default: str) -> None:
        p.add_argument("--output_format", choices=("csv", "graphml"), default=default)
        p.add_argument("--include_self_loops", action="store_true")
        p.add_argument("--n_messages", type=int, default=10)

    p = sub.add_parser("compute", help="derive a network")
    p.add_argument("network_type", choices=NETWORKS)
    p.add_argument("--time_window", type=float, default=1)
    p.add_argument("--min_edge_weight", type=int, default=2)
    p.add_argument("--similarity_threshold", type=float, default=0.8)
    p.add_argument("--min_document_size_similarity", type=int, default=1)
    p.add_argument("--resolved", action="store_true")
    p.add_argument("--n_cpus", type=int, default=None, help="local cores, where the session is not given a master")
    p.add_argument("--reprocess_text", action="store_true", help="accepted; text is derived anew by each run")
    p.add_argument("--word_boundaries", action="store_true", help="tokens at Unicode word boundaries (slower)")
    p.add_argument("--output_file")
    exported(p, "graphml")
    p = sub.add_parser("export_network", help="write a computed network")
    p.add_argument("output_file")
    p.add_argument("network_type", choices=NETWORKS)
    exported(p, "graphml")
    p = sub.add_parser("export_user_nodes", help="write all accounts with their latest messages")
    p.add_argument("output_file")
    p.add_argument("--n_messages", type=int, default=10)
    return top


def compute(store: Store, a: argparse.Namespace):
    kind, w, least = a.network_type, a.time_window, a.min_edge_weight
    if kind == "co_link":
        return networks.co_link(store.resolved_message_urls() if a.resolved else store.message_urls(), w, least, a.resolved)
    if kind == "co_similar_tweet":
        tokenizer = text.word_tokens if a.word_boundaries else text.tokens
        return networks.co_similar_tweet(store.messages(), w, a.similarity_threshold, least, a.min_document_size_similarity, tokenizer=tokenizer)
    return getattr(networks, kind)(store.messages(), w, least)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("tandem").config("spark.sql.session.timeZone", "UTC")
        if getattr(a, "n_cpus", None):
            builder = builder.master(f"local[{a.n_cpus}]")
        spark = builder.getOrCreate()
    store = Store(spark, a.store)
    if a.command == "preprocess":
        read = {"csv": messages.read_csv, "twitter_json": messages.read_posts_json, "twitter_v2_likes_retweets": messages.read_likes_json}[a.format]
        store.append(read(spark, a.files), not a.drop_empty_urls, only_empty=a.format == "twitter_v2_likes_retweets")
    elif a.command == "resolve_urls":
        most = a.max_redirects
        found = links.resolve_pending(store.message_urls(), store.resolved(), lambda u: links.resolve_url(u, max_redirects=most))
        resolved = store.put("resolved_url", found)
        store.put("resolved_message_url", links.resolved_message_urls(store.message_urls(), resolved))
    elif a.command == "compute":
        network = store.put(f"{a.network_type}_network", compute(store, a))
        if a.output_file:
            outputs.write_output(network, a.network_type, store.messages(), a.output_file, a.output_format, a.include_self_loops, a.n_messages)
    elif a.command == "export_network":
        outputs.write_output(store.network(a.network_type), a.network_type, store.messages(), a.output_file, a.output_format, a.include_self_loops, a.n_messages)
    else:
        outputs.write_node_csv(store.messages(), a.output_file, a.n_messages)

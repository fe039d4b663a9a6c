"""Queries over the reference operators, and the SQL that checks them."""

from quarrymill.plans import oracles
from quarrymill.plans import queries as q

QUERIES = {
    "leading_comments": q.leading_comments,
    "quality_filter": q.quality_filter,
    "predicate_rejects": q.predicate_rejects,
    "small_groups": q.small_groups,
    "repo_selection": q.repo_selection,
    "url_parts": q.url_parts,
    "token_bags": q.token_bags,
    "token_frequency": q.token_frequency,
    "content_ids": q.content_ids,
    "sim_jaccard": q.sim("jaccard"),
    "sim_cosine": q.sim("cosine", members=True),
    "sim_containment_min": q.sim("containment_min"),
    "sim_containment": q.sim("containment", members=True),
    "sim_query": q.sim_query,
    "exact_groups": q.exact_groups,
    "neighbour_lists": q.neighbour_lists,
    "dedup_greedy": q.dedup_greedy,
    "keep_first": q.keep_first,
    "top_n": q.top_n,
    "capped_sample": q.capped_sample,
    "quota_sample": q.quota_sample,
    "one_per_group": q.one_per_group,
    "train_split": q.train_split,
    "sft_rows": q.sft_rows,
    "prompt_messages": q.prompt_messages,
    "generated": q.generated,
    "versions": q.versions,
    "unpivot": q.unpivot,
    "tag_extract": q.tag_extract,
    "json_parse": q.json_parse,
    "literal_parse": q.literal_parse,
    "kappa_ci": q.kappa_ci,
    "prf_micro": q.prf_micro,
    "prf_macro": q.prf_macro,
    "exploded_sizes": q.exploded_sizes,
    "rater_pairs": q.rater_pairs,
    "rater_kappa": q.rater_kappa,
    "split_share": q.split_share,
    "status_counts": q.status_counts,
    "merged_versions": q.merged_versions,
    "graph_texts": q.graph_texts,
    "diagram_rows": q.diagram_rows,
    "question_rows": q.question_rows,
    "graph_check": q.graph_check,
    "graph_components": q.graph_components,
    "severity_rollup": q.severity_rollup,
    "render_plantuml": q.rendering("plantuml"),
    "render_mermaid": q.rendering("mermaid"),
    "render_flowchart": q.rendering("flowchart"),
}
ORACLE_SQL = {name: sql for name, sql in oracles.SQL.items() if name in QUERIES}

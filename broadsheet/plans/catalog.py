"""All registered queries: name to (query, SQL or None)."""

from broadsheet.plans import corpus_queries, enrich_queries, registry_queries, search_queries, text_queries

QUERIES = {
    **search_queries.QUERIES,
    **corpus_queries.QUERIES,
    **registry_queries.QUERIES,
    **text_queries.QUERIES,
    **enrich_queries.QUERIES,
}

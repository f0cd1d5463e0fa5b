"""The same derived tables as DuckDB text, for the oracle queries."""

VIEWS = {
    "docs": r"""docs AS (SELECT doc_id, source, lang, n_chars,
  translate(regexp_replace(lower(text),'[^a-z]','','g'),'abcdefghijklmnopqrstuvwxyz','ACGUACGUACGUACGUACGUACGUAC') AS rna,
  upper(translate(regexp_replace(lower(text),'[^a-z]','','g'),'bjouxz','')) AS prot FROM documents)""",
    "proteins": """proteins AS (SELECT source AS protein_name, min_by(prot, doc_id) AS protein_sequence
  FROM docs WHERE length(prot) >= 30 GROUP BY source)""",
    "document_proteins": """document_proteins AS (SELECT concat_ws('d', source, doc_id) AS protein_name, prot AS protein_sequence FROM docs WHERE length(prot) >= 30)""",
    "pairs": """pairs AS (SELECT 'pair_' || doc_id || '_' || off AS pair_id, doc_id, off, source AS protein_name,
  substr(rna, off+1, 60) AS rna_sequence, quality AS binding_label, lang AS dataset_source,
  source || '_' || (doc_id % 3) AS experiment_id,
  CASE lang WHEN 'en' THEN 'Homo sapiens' WHEN 'de' THEN 'Mus musculus' WHEN 'fr' THEN 'Danio rerio' END AS organism,
  n_chars::DOUBLE / (off+1) AS probe_intensity,
  CASE WHEN off % 7 < 4 THEN 'train' WHEN off % 7 = 4 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT d.*, l.quality, unnest(CASE WHEN length(rna) <= 60 THEN [0::BIGINT] ELSE list_concat(range(0, length(rna)-59, 60),
     CASE WHEN (length(rna)-60) % 60 <> 0 THEN [length(rna)-60] ELSE [] END) END) AS off
     FROM docs d JOIN labels l USING (doc_id) WHERE length(rna) >= 4))""",
    "pairs_seq": "pairs_seq AS (SELECT p.*, d.prot AS protein_sequence FROM pairs p JOIN docs d USING (doc_id) WHERE length(d.prot) >= 30)",
    "scores": """scores AS (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || floor(l_extendedprice*100+0.5::DOUBLE)::BIGINT AS row_id,
  'P' || l_suppkey AS protein_name, 'R' || l_partkey AS rna_id,
  CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS binding_label, l_quantity/50 AS score_a, l_discount AS score_b,
  l_extendedprice AS score_c, 'F' || (l_suppkey % 7) AS family, (l_suppkey % 10)/10.0::DOUBLE AS identity, l_linestatus AS source FROM lineitem)""",
    "intervals": """intervals AS (SELECT event_type AS chrom, floor(epoch(ts)-epoch(timestamp '2024-01-01'))::BIGINT AS start_pos,
  floor(epoch(ts)-epoch(timestamp '2024-01-01'))::BIGINT + 900 AS end_pos, 'e' || event_id AS name, value AS score,
  CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, (user_id % 2)::INT AS side, 'exp' || (user_id % 12) AS experiment_id FROM events)""",
    "hits": """hits AS (SELECT 'Q' || l_suppkey AS query, 'T' || (l_partkey % 200) AS target, l_discount*9 AS fident,
  l_quantity/50 AS qcov, l_tax*12 AS tcov, l_extendedprice AS bits FROM lineitem)""",
    "names": """names AS (SELECT p_brand AS protocol, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || '-construct' || (p_size % 3) END AS native_name,
  p_type AS domain_class, p_retailprice AS z, p_partkey AS row_no, p_size AS size FROM part)""",
    "reads": """reads AS (SELECT 'G' || (l_partkey % 40) AS gene1, 'G' || (l_suppkey % 40) AS gene2, l_returnflag || l_linestatus AS library FROM lineitem)""",
    "literature": r"""literature AS (SELECT 'curated_' || item_id AS pair_id, 'L' || (item_id % 20) AS protein_name,
  upper(translate(regexp_replace(lower(text),'[^a-z]','','g'),'bjouxz','')) AS protein_sequence,
  translate(regexp_replace(lower(text),'[^a-z]','','g'),'abcdefghijklmnopqrstuvwxyz','ACGUACGUACGUACGUACGUACGUAC') AS rna_sequence,
  CASE WHEN item_id % 4 <> 3 THEN 1 ELSE 0 END AS binding_label FROM benchmark)""",
    "emb": "emb AS (SELECT 'V' || vec_id AS protein_name, embedding, 'fam' || label AS family FROM embeddings)",
}
NEEDS = {"proteins": ["docs"], "document_proteins": ["docs"], "pairs": ["docs"], "pairs_seq": ["pairs"]}


def sql(views: str, body: str) -> str:
    """Body with the named views (and what they need) put in front as CTEs.

    A body that starts with ``WITH`` or ``WITH RECURSIVE`` has its own CTEs appended.
    """
    order: list[str] = []

    def add(v):
        for n in NEEDS.get(v, []):
            add(n)
        if v not in order:
            order.append(v)

    for v in views.split():
        add(v)
    head = ",\n".join(VIEWS[v] for v in order)
    body = body.strip()
    if not head:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"

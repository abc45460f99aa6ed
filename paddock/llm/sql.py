"""SQL with the meaning of the corpus queries that SQL can express, for comparison."""

_GROUPS = """e AS (SELECT loser a, keeper b FROM horse_merge_log WHERE NOT rolled_back AND loser IS NOT NULL AND keeper IS NOT NULL AND loser <> keeper),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM w UNION SELECT r.a, w.b FROM r JOIN w ON r.b = w.a),
g AS (SELECT a horse_id, least(a, min(b)) group_id FROM r GROUP BY a)"""

P5_FOUND = f"WITH RECURSIVE {_GROUPS} SELECT group_id, horse_id FROM g"

_NAMES = "('', '-', '?', 'N.N.', 'NN', 'N N', 'OKÄND', 'OKAND', 'UNKNOWN', 'UNBEKANNT', 'INCONNU', 'UKENDT', 'UKJENT', 'NULL', 'NONE')"
_CODES = "('', '-', '?', '--', '??', 'XX', 'X', 'UNKNOWN', 'NULL', 'NONE')"


def _field(name: str) -> str:
    if name == "date_of_birth":
        return f"SELECT '{name}' field_name, * FROM k WHERE date_of_birth::VARCHAR NOT IN ('1900-01-01', '1910-11-12', '1970-01-01', '2099-12-31') AND date_of_birth <= DATE '2025-01-31'"
    return f"SELECT '{name}' field_name, * FROM k WHERE upper(trim({name})) NOT IN {_NAMES if 'name' in name else _CODES} AND regexp_matches({name}, '\\p{{L}}')"


P4_FOUND = f"""WITH RECURSIVE {_GROUPS},
k AS (SELECT h.*, g.group_id, count(*) OVER (PARTITION BY g.group_id) n,
  CASE WHEN last_updated_at < TIMESTAMP '2025-02-01' THEN last_updated_at ELSE TIMESTAMP '0001-01-01' END seen,
  coalesce(replace(nullif(regexp_replace(lower(primary_source), '[^a-z]', '', 'g'), ''), 'travsport', 'st'), regexp_extract(source_data, '"(usta|st|letrot|hvt|atg|breedly|kmtid)"\\s*:\\s*\\{{', 1)) src
  FROM horse h JOIN g USING (horse_id)),
c AS ({' UNION ALL '.join(map(_field, ('name', 'date_of_birth', 'gender_code', 'birth_country', 'sire_name', 'dam_name')))}),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY coalesce(nullif(list_position(['usta', 'st', 'letrot', 'hvt', 'atg', 'breedly', 'kmtid'], src), 0), 8), seen DESC, horse_id) rn FROM c WHERE n > 1)
SELECT group_id, field_name, horse_id FROM o WHERE rn = 1"""

SQL = {"p4_found": P4_FOUND, "p5_found": P5_FOUND}

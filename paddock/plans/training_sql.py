"""SQL with the meaning of the core training-data queries, for comparison."""

_LINKS = """l AS (
  SELECT 'sire' lineage, horse_id node, sire_id parent FROM horse WHERE sire_id IN (SELECT horse_id FROM horse)
  UNION ALL SELECT 'dam', horse_id, dam_id FROM horse WHERE dam_id IN (SELECT horse_id FROM horse)),
up AS (
  SELECT lineage, node, parent apex, 1 n, node || '' p FROM l
  UNION ALL SELECT up.lineage, up.node, l.parent, n + 1, up.apex || '>' || p FROM up JOIN l ON l.lineage = up.lineage AND l.node = up.apex WHERE n < 300),
climbed AS (SELECT * FROM up WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.lineage = up.lineage AND l.node = up.apex))"""

_STANDING = "standing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY last_updated_at DESC NULLS LAST) rn FROM entry WHERE entry_id IS NOT NULL) WHERE rn = 1)"

P1_FOUND = f"""WITH RECURSIVE {_LINKS},
anc AS (SELECT node a, parent b FROM l UNION SELECT anc.a, l.parent FROM anc JOIN l ON l.node = anc.b)
SELECT lineage, node horse_id, apex root_id, n n_steps FROM climbed
UNION ALL SELECT 'loop', p.a, min(p.b), count(*)::INT FROM anc p JOIN anc q ON p.a = q.b AND p.b = q.a GROUP BY p.a"""

P1_HIERARCHY = f"""WITH RECURSIVE {_LINKS},
whole AS (SELECT lineage, node, apex, n, apex || '>' || p p FROM climbed),
nodes AS (SELECT * FROM whole UNION ALL SELECT DISTINCT lineage, apex, apex, 0, apex || '' FROM climbed),
below AS (SELECT up.lineage, up.apex node, count(*) k FROM up JOIN climbed c ON c.lineage = up.lineage AND c.node = up.node GROUP BY ALL)
SELECT nodes.lineage, nodes.node horse_id, nodes.apex root_id, n n_steps, p path, coalesce(k, 0)::BIGINT n_descendants FROM nodes LEFT JOIN below USING (lineage, node)"""

P1_DESCENDANTS = f"""WITH RECURSIVE {_LINKS}
SELECT up.lineage, up.apex horse_id, up.node descendant_id, up.n n_steps FROM up JOIN climbed c ON c.lineage = up.lineage AND c.node = up.node"""

P1_ALL_DESCENDANTS = f"""WITH RECURSIVE {_LINKS},
anc AS (SELECT node a, parent b FROM l UNION SELECT anc.a, l.parent FROM anc JOIN l ON l.node = anc.b)
SELECT b horse_id, a descendant_id FROM anc"""

P3_FOUND = f"""WITH {_STANDING},
v AS (SELECT f.entry_id, f.race_date, h.from_date, h.trainer_id, h.to_date,
  row_number() OVER (PARTITION BY f.entry_id, h.from_date ORDER BY h.recorded_at DESC, h.trainer_id DESC NULLS LAST, h.to_date DESC NULLS LAST) rn
  FROM entry_features f JOIN horse_trainer_history h ON f.horse_id = h.horse_id AND h.recorded_at < f.race_date),
t AS (SELECT entry_id, any_value(race_date) race_date, max_by(trainer_id, from_date) tid FROM v
  WHERE rn = 1 AND trainer_id IS NOT NULL AND from_date <= race_date AND (to_date IS NULL OR race_date < to_date) GROUP BY entry_id),
fm AS (SELECT s.trainer_id, x.race_date, max(x.entry_id) ref FROM trainer_form_exp x JOIN standing s USING (entry_id) WHERE s.trainer_id IS NOT NULL GROUP BY ALL)
SELECT entry_id, 'trainer' attr_name, tid::BIGINT ref_id FROM t
UNION ALL SELECT t.entry_id, 'form', fm.ref FROM t ASOF JOIN fm ON t.tid = fm.trainer_id AND t.race_date > fm.race_date"""

_FORM = f"""{_STANDING},
f AS (SELECT x.*, s.trainer_id FROM trainer_form_exp x JOIN standing s USING (entry_id))"""

P7_FOUND = f"""WITH {_FORM},
m AS (SELECT a.entry_id, any_value(a.tf_posbeat_90) pb, any_value(a.tf_beatrate_90) br, avg(b.y_outperf) mp, avg(b.y_beat_exp) mb
  FROM f a LEFT JOIN f b ON a.trainer_id = b.trainer_id AND b.race_date BETWEEN a.race_date - 90 AND a.race_date - 1 GROUP BY a.entry_id)
SELECT entry_id FROM m WHERE coalesce(abs(pb - mp) > 0.001, (pb IS NULL) <> (mp IS NULL)) OR coalesce(abs(br - mb) > 0.001, (br IS NULL) <> (mb IS NULL))"""


def _period(p: int) -> str:
    inside = f"FILTER (b.race_date >= c.race_date - {p})"
    return f"""coalesce(sum(n) {inside}, 0)::BIGINT n_{p}, (sum(beat) {inside})::BIGINT beat_{p}, (sum(outperf) {inside})::DOUBLE outperf_{p},
  (sum(beat) {inside})::DOUBLE / nullif(sum(beat_n) {inside}, 0) beatrate_{p}, (sum(outperf) {inside})::DOUBLE / nullif(sum(outperf_n) {inside}, 0) posbeat_{p}"""


P7_ROLLING = f"""WITH {_FORM},
d AS (SELECT trainer_id, race_date, count(*) n, sum(y_beat_exp) beat, count(y_beat_exp) beat_n, sum(y_outperf::DECIMAL(18, 6)) outperf, count(y_outperf) outperf_n FROM f WHERE trainer_id IS NOT NULL GROUP BY ALL),
c AS (SELECT trainer_id, unnest(generate_series(min(race_date), (SELECT max(race_date) FROM d), INTERVAL 1 DAY))::DATE race_date FROM d GROUP BY trainer_id)
SELECT c.trainer_id, c.race_date, {', '.join(map(_period, (7, 30, 90)))}
FROM c LEFT JOIN d b ON b.trainer_id = c.trainer_id AND b.race_date BETWEEN c.race_date - 90 AND c.race_date - 1 GROUP BY c.trainer_id, c.race_date"""

SQL = {"p1_found": P1_FOUND, "p1_hierarchy": P1_HIERARCHY, "p1_descendants": P1_DESCENDANTS, "p1_all_descendants": P1_ALL_DESCENDANTS, "p3_found": P3_FOUND, "p7_found": P7_FOUND, "p7_rolling": P7_ROLLING}

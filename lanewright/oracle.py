"""SQL (DuckDB) for the registered queries, from the raw tables alone."""

from __future__ import annotations

HAV = "2*6371000.0::DOUBLE*asin(sqrt(pow(sin(radians({b}.lat-{a}.lat)/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2)))"
LAT, LON = "40.7345::DOUBLE", "(-73.9712::DOUBLE)"
R = lambda x, n: f"floor(({x})*1e{n}::DOUBLE+0.5::DOUBLE)/1e{n}::DOUBLE"

CELLS = """cells AS (SELECT p_partkey p, p_partkey//400 blk, (p_partkey%400)//20 r, p_partkey%20 c, p_size%3<>0 AS open,
 CASE WHEN p_size%7<>0 THEN p_retailprice-900 END ele, p_type, p_brand FROM part),
nodes AS (SELECT CAST(blk AS VARCHAR) area_id, CAST(p AS VARCHAR) id, 40.70::DOUBLE+r*0.0036::DOUBLE lat, -74.02::DOUBLE+c*0.0052::DOUBLE lon, ele, p, r, c, blk FROM cells WHERE open),
raw_ways AS (
 SELECT blk, concat_ws('-','r',blk,r) way_id, list(CAST(p AS VARCHAR) ORDER BY c) refs, arg_min(p_type,p) kind, arg_min(p_brand,p) brand FROM cells GROUP BY blk,r
 UNION ALL SELECT blk, concat_ws('-','c',blk,c), list(CAST(p AS VARCHAR) ORDER BY r), arg_min(p_type,p), arg_min(p_brand,p) FROM cells GROUP BY blk,c
 UNION ALL SELECT blk, concat_ws('-','d',p), [CAST(p AS VARCHAR), CAST(p+21 AS VARCHAR)], p_type, p_brand FROM cells WHERE r<19 AND c<19 AND (r+c)%5=0),
ways AS (SELECT CAST(blk AS VARCHAR) area_id, way_id, refs,
 CASE kind WHEN 'MEDIUM' THEN 'residential' WHEN 'STANDARD' THEN 'footway' WHEN 'LARGE' THEN 'motorway_link' WHEN 'PROMO' THEN 'primary' WHEN 'SMALL' THEN NULL ELSE 'unclassified' END highway,
 CASE WHEN brand LIKE '%1' THEN 'no' WHEN brand LIKE '%2' THEN 'unknown' WHEN brand LIKE '%3' THEN 'yes' END foot,
 CASE WHEN brand LIKE '%4' THEN 'no' WHEN brand LIKE '%5' THEN 'designated' END bicycle FROM raw_ways),
segs AS (SELECT area_id, way_id, i-1 pos, refs[i] u, refs[i+1] v FROM (SELECT *, unnest(range(1,len(refs))) i FROM ways))"""

EDGES = (
    CELLS
    + f""",
edges AS (SELECT s.area_id, least(u,v) src, greatest(u,v) dst, min({HAV.format(a="a", b="b")}) len
 FROM segs s JOIN nodes a ON a.area_id=s.area_id AND a.id=u JOIN nodes b ON b.area_id=s.area_id AND b.id=v GROUP BY 1,2,3),
arcs AS (SELECT area_id, src u, dst v, len FROM edges UNION ALL SELECT area_id, dst, src, len FROM edges),
deg AS (SELECT area_id, u id, count(*) degree FROM arcs GROUP BY 1,2)"""
)

#: All pairs of connected nodes; the label of a node is the least it reaches.
LABELS = (
    EDGES
    + """,
reach(area_id, s, t) AS (SELECT area_id, u, u FROM arcs UNION SELECT r.area_id, r.s, a.v FROM reach r JOIN arcs a ON a.area_id=r.area_id AND a.u=r.t),
labels AS (SELECT area_id, s id, min(t) component FROM reach GROUP BY 1,2),
sizes AS (SELECT area_id, component, count(*) n FROM labels GROUP BY 1,2),
largest AS (SELECT area_id, component, n FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY n DESC, component) k FROM sizes) WHERE k=1),
big AS (SELECT l.area_id, l.id FROM labels l JOIN largest g ON g.area_id=l.area_id AND g.component=l.component),
kept AS (SELECT e.* FROM edges e JOIN big b ON b.area_id=e.area_id AND b.id=e.src)"""
)

#: Shortest distances from chosen sources, improved until nothing changes.
DIST = """,
dist(area_id, s, id, d) USING KEY (area_id, s, id) AS (
 SELECT area_id, s, s, 0.0::DOUBLE FROM sources
 UNION SELECT x.area_id, x.s, a.v, min(x.d+a.len) FROM dist x JOIN arcs a ON a.area_id=x.area_id AND a.u=x.id
 LEFT JOIN recurring.dist y ON y.area_id=x.area_id AND y.s=x.s AND y.id=a.v
 WHERE y.d IS NULL OR x.d+a.len<y.d GROUP BY 1,2,3)"""

SEEDED = (
    CELLS
    + """,
centres(zone,y,x) AS (VALUES (0,40.715::DOUBLE,-74.0::DOUBLE),(1,40.735::DOUBLE,-73.97::DOUBLE),(2,40.755::DOUBLE,-73.93::DOUBLE)),
zoned AS (SELECT area_id, id, lat, lon, zone FROM (SELECT n.*, zone, row_number() OVER (PARTITION BY area_id,id ORDER BY (lat-y)*(lat-y)+(lon-x)*(lon-x), zone) k FROM nodes n, centres) WHERE k=1)"""
)
ZONES = EDGES + SEEDED.removeprefix(CELLS)
CENTRE = (
    ZONES
    + """,
ez AS (SELECT e.area_id, src, dst, zone FROM edges e JOIN zoned z ON z.area_id=e.area_id AND z.id=e.src),
touched AS (SELECT area_id, zone, src id FROM ez UNION SELECT area_id, zone, dst FROM ez),
centre AS (SELECT t.area_id, t.zone, avg(lat) lat, avg(lon) lon FROM touched t JOIN nodes n ON n.area_id=t.area_id AND n.id=t.id GROUP BY 1,2)"""
)

#: The nearest point to the centre of each segment of two open nodes, in metres.
_M = "radians(1)*6371000.0::DOUBLE"
PASSES = f"""flat AS (SELECT s.area_id, s.way_id, (a.lat-pt.lat)*{_M} y1, (a.lon-pt.lon)*{_M}*cos(radians(pt.lat)) x1, (b.lat-pt.lat)*{_M} y2, (b.lon-pt.lon)*{_M}*cos(radians(pt.lat)) x2
 FROM segs s JOIN nodes a ON a.area_id=s.area_id AND a.id=u JOIN nodes b ON b.area_id=s.area_id AND b.id=v, pt),
along AS (SELECT *, greatest(0, least(1, -(x1*(x2-x1)+y1*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) t FROM flat),
near AS (SELECT area_id, way_id, x1+t*(x2-x1) px, y1+t*(y2-y1) py FROM along)"""

#: Twelve rounds of k-means from four seeds by longitude.
KMEANS = """,
k0 AS (SELECT area_id, CAST(s AS INTEGER) zone, lat y, lon x FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY lon, id)-1 k, count(*) OVER (PARTITION BY area_id) n FROM nodes), range(4) r(s) WHERE k=(s*(n-1))//3)""" + "".join(
    f""",
z{r} AS MATERIALIZED (SELECT area_id, id, lat, lon, zone FROM (SELECT n.*, zone, row_number() OVER (PARTITION BY n.area_id, id ORDER BY (lat-y)*(lat-y)+(lon-x)*(lon-x), zone) k FROM nodes n JOIN k{r - 1} c ON c.area_id=n.area_id) WHERE k=1),
k{r} AS MATERIALIZED (SELECT c.area_id, c.zone, coalesce(m.y, c.y) y, coalesce(m.x, c.x) x FROM k{r - 1} c LEFT JOIN (SELECT area_id, zone, sum(lat ORDER BY id)/count(*) y, sum(lon ORDER BY id)/count(*) x FROM z{r} GROUP BY 1,2) m ON m.area_id=c.area_id AND m.zone=c.zone)"""
    for r in range(1, 13)
)

LINES = CELLS + """,
pts AS (SELECT w.area_id, w.way_id, k pos, n.lat, n.lon, n.ele FROM (SELECT *, unnest(range(len(refs))) k FROM ways) w JOIN nodes n ON n.area_id=w.area_id AND n.id=w.refs[k+1]),
steps AS (SELECT area_id, way_id, ele-lag(ele) OVER (PARTITION BY area_id,way_id ORDER BY pos) d FROM pts),
climb AS (SELECT area_id, way_id, CASE WHEN count(d)>0 THEN CAST(floor(sum(greatest(d,0))+0.5) AS BIGINT) END elev_gain_m,
 CASE WHEN count(d)>0 THEN CAST(floor(sum(greatest(-d,0))+0.5) AS BIGINT) END elev_loss_m FROM steps GROUP BY 1,2)"""

EVENTS = "ev AS (SELECT user_id, event_id seq, epoch_us(ts)//1000 tm, event_type, value FROM events)"
GATE = f"""WITH RECURSIVE {EVENTS},
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm, seq) k FROM ev),
g(user_id, seq, k, last, accepted) AS (SELECT user_id, seq, k, tm, true FROM o WHERE k=1
 UNION ALL SELECT o.user_id, o.seq, o.k, CASE WHEN o.tm-g.last>=21600000 THEN o.tm ELSE g.last END, o.tm-g.last>=21600000 FROM g JOIN o ON o.user_id=g.user_id AND o.k=g.k+1)
SELECT user_id, seq, accepted FROM g"""

STATUS = "CASE WHEN status=429 THEN 'rate limited: wait a minute before the next plan' WHEN status IN (502,503,504) THEN 'servers overloaded: try again in a minute or choose a smaller area' WHEN status=400 THEN 'the query was rejected' ELSE 'server error '||status END"
ATTEMPTS = """att AS (SELECT o_orderkey request_id, t ord, 'mirror'||t endpoint, CASE WHEN n<3 THEN 200 WHEN n=3 THEN 429 WHEN n=4 THEN 503 WHEN n=5 THEN 400 WHEN n=6 THEN 500 WHEN n=7 THEN 404 END status, CASE WHEN n=0 THEN 0 ELSE 10 END n_elements
 FROM (SELECT o_orderkey, t, (o_orderkey*7+t*5)%9 n FROM orders, range(3) x(t)))"""

KEY4 = lambda x: f"CAST(CAST({R(x, 4)} AS DECIMAL(14,4)) AS VARCHAR)"
NUM = lambda x: f"regexp_replace(CAST(CAST({x} AS DECIMAL(14,9)) AS VARCHAR), '\\.?0+$', '')"

ORACLE_SQL = {
    "city_nodes": f"WITH {CELLS} SELECT area_id, id, lat, lon, ele FROM nodes",
    "city_ways": f"WITH {CELLS} SELECT area_id, way_id, array_to_string(refs, ',') refs, highway, foot, bicycle FROM ways",
    "way_segments": f"WITH {CELLS} SELECT area_id, way_id, CAST(pos AS BIGINT) pos, u, v FROM segs",
    "dangling_refs": f"WITH {CELLS} SELECT w.area_id, way_id, w.id FROM (SELECT area_id, way_id, unnest(refs) id FROM ways) w ANTI JOIN nodes n ON n.area_id=w.area_id AND n.id=w.id",
    "edge_dedup_min": "SELECT 'o' area_id, least(u,v) src, greatest(u,v) dst, min(len) len FROM (SELECT CAST(o_custkey AS VARCHAR) u, CAST(o_orderkey%97 AS VARCHAR) v, o_totalprice len FROM orders) WHERE u<>v AND len>0 GROUP BY 1,2,3",
    "haversine_lengths": f"WITH {EDGES} SELECT area_id, src, dst, {R('len', 6)} len FROM edges",
    "node_degree": f"WITH {EDGES} SELECT area_id, id, degree FROM deg",
    "odd_nodes": f"WITH {EDGES} SELECT area_id, id FROM deg WHERE degree%2=1",
    "bare_length": f"WITH {EDGES} SELECT area_id, {R('sum(len)', 3)} bare_m FROM edges GROUP BY 1",
    "graph_shape": f"WITH {EDGES} SELECT e.area_id, nodes, edges, total FROM (SELECT area_id, count(*) edges, {R('sum(len)', 3)} total FROM edges GROUP BY 1) e JOIN (SELECT area_id, count(*) nodes FROM deg GROUP BY 1) d USING (area_id)",
    "nearest_node": f"WITH {CELLS} SELECT area_id, id, {R('d2', 9)} d2 FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY d2, id) k FROM (SELECT area_id, id, (lat-{LAT})*(lat-{LAT})+(lon-{LON})*(lon-{LON}) d2 FROM nodes)) WHERE k=1",
    "area_filter_walk": f"WITH {CELLS} SELECT area_id, way_id FROM ways WHERE highway IS NOT NULL AND NOT regexp_matches(highway, 'motorway|motorway_link|trunk|trunk_link|construction|proposed|raceway') AND NOT coalesce(contains(foot,'no'), false)",
    "area_filter_drive": f"WITH {CELLS} SELECT area_id, way_id FROM ways WHERE regexp_matches(highway, 'motorway|trunk|primary|secondary|tertiary|unclassified|residential|living_street|service')",
    "area_filter_bike": f"WITH {CELLS} SELECT area_id, way_id FROM ways WHERE highway IS NOT NULL AND NOT coalesce(contains(bicycle,'no'), false) AND NOT regexp_matches(highway, 'motorway|motorway_link|footway|steps|construction|proposed')",
    "radius_ways": f"WITH {CELLS}, pt AS (SELECT {LAT} lat, {LON} lon), inside AS (SELECT n.area_id, n.id FROM nodes n, pt WHERE {HAV.format(a='pt', b='n')}<=1500), refs AS (SELECT area_id, way_id, unnest(refs) id FROM ways WHERE highway IS NOT NULL AND NOT regexp_matches(highway, 'motorway|motorway_link|trunk|trunk_link|construction|proposed|raceway') AND NOT coalesce(contains(foot,'no'), false)), {PASSES}, hit AS (SELECT DISTINCT r.area_id, way_id FROM refs r JOIN inside i ON i.area_id=r.area_id AND i.id=r.id UNION SELECT area_id, way_id FROM near WHERE px*px+py*py<=1500*1500 AND way_id IN (SELECT way_id FROM refs)) SELECT area_id, way_id id, 'way' kind FROM hit UNION ALL SELECT DISTINCT r.area_id, r.id, 'node' FROM refs r JOIN hit h ON h.way_id=r.way_id AND h.area_id=r.area_id JOIN nodes n ON n.area_id=r.area_id AND n.id=r.id",
    "element_filter": f"WITH {CELLS} SELECT area_id, 'node' AS type, count(*) n FROM nodes GROUP BY 1 UNION ALL SELECT area_id, 'way', count(*) FROM ways GROUP BY 1",
    "osm_parse": f"WITH {EDGES} SELECT area_id, src, dst, {R('len', 6)} len FROM edges",
    "components": f"WITH RECURSIVE {LABELS} SELECT area_id, id, component FROM labels",
    "components_wide": f"WITH RECURSIVE {LABELS} SELECT area_id, id, component FROM labels",
    "largest_component": f"WITH RECURSIVE {LABELS} SELECT area_id, component, n FROM largest",
    "junctions": f"WITH {EDGES} SELECT area_id, id FROM deg WHERE degree<>2",
    "isolated_loops": """WITH RECURSIVE rings AS (SELECT CAST(n_regionkey AS VARCHAR) area_id, n_nationkey n, 3+n_nationkey%4 m FROM nation),
 e AS (SELECT area_id, 'n'||n||'_'||i u, 'n'||n||'_'||((i+1)%m) v FROM (SELECT *, unnest(range(m)) i FROM rings)
  UNION SELECT area_id, 'n'||n||'_0', 'n'||n||'_t' FROM rings WHERE n%3=0 UNION SELECT area_id, 'n'||n||'_0', 'n'||n||'_2' FROM rings WHERE n%5=0 AND m>3),
 arcs AS (SELECT area_id, u, v FROM e UNION SELECT area_id, v, u FROM e), deg AS (SELECT area_id, u id, count(*) degree FROM arcs GROUP BY 1,2),
 reach(area_id, s, t) AS (SELECT area_id, u, u FROM arcs UNION SELECT r.area_id, r.s, a.v FROM reach r JOIN arcs a ON a.area_id=r.area_id AND a.u=r.t),
 labels AS (SELECT area_id, s id, min(t) component FROM reach GROUP BY 1,2)
SELECT l.area_id, component FROM labels l JOIN deg d ON d.area_id=l.area_id AND d.id=l.id GROUP BY 1,2 HAVING bool_and(degree=2)""",
    "csr_arrays": f"WITH {EDGES}, num AS (SELECT area_id, id, row_number() OVER w - 1 number, CAST(sum(degree) OVER w - degree AS BIGINT) first FROM deg WINDOW w AS (PARTITION BY area_id ORDER BY id)) SELECT n.area_id, n.id, n.number, n.first, string_agg(CAST(m.number AS VARCHAR), ',' ORDER BY m.number) near, string_agg(CAST(CAST({R('a.len', 0)} AS BIGINT) AS VARCHAR), ',' ORDER BY m.number) len FROM num n JOIN arcs a ON a.area_id=n.area_id AND a.u=n.id JOIN num m ON m.area_id=a.area_id AND m.id=a.v GROUP BY 1,2,3,4",
    "multigraph": f"WITH {EDGES}, again AS (SELECT area_id, least(u,v) src, greatest(u,v) dst, count(*) n FROM segs GROUP BY 1,2,3) SELECT e.area_id, e.src, e.dst, {R('len', 6)} len, 1+coalesce(n,0) mult FROM edges e LEFT JOIN again a ON a.area_id=e.area_id AND a.src=e.src AND a.dst=e.dst",
    "nearest_target": f"WITH RECURSIVE {LABELS}, sources AS (SELECT area_id, component s FROM largest){DIST}, t AS (SELECT area_id, id FROM deg WHERE degree%2=1 AND id LIKE '%7'), hit AS (SELECT d.area_id, d.s, d.id, d.d, row_number() OVER (PARTITION BY d.area_id ORDER BY d.d, d.id) k FROM dist d JOIN t ON t.area_id=d.area_id AND t.id=d.id) SELECT x.area_id, x.s source, h.id target, {R('h.d', 3)} dist FROM sources x LEFT JOIN hit h ON h.area_id=x.area_id AND k=1 WHERE x.area_id IN (SELECT area_id FROM t)",
    "subgraph": f"WITH {EDGES} SELECT e.area_id, src, dst, {R('len', 6)} len FROM edges e JOIN nodes a ON a.area_id=e.area_id AND a.id=src JOIN nodes b ON b.area_id=e.area_id AND b.id=dst WHERE a.lon<-73.96::DOUBLE AND b.lon<-73.96::DOUBLE",
    "sssp_corner": f"WITH RECURSIVE {LABELS}, sources AS (SELECT area_id, component s FROM largest){DIST} SELECT area_id, s source, id, {R('d', 3)} dist FROM dist",
    "shortest_paths": f"WITH RECURSIVE {LABELS}, sources AS (SELECT area_id, min(id) s FROM big GROUP BY 1), targets AS (SELECT area_id, max(id) t FROM big GROUP BY 1){DIST}, came AS (SELECT a.area_id, a.v id, min(a.u) u FROM arcs a JOIN dist x ON x.area_id=a.area_id AND x.id=a.u JOIN dist y ON y.area_id=a.area_id AND y.id=a.v WHERE x.d+a.len=y.d GROUP BY 1,2), back(area_id, id, path) AS (SELECT area_id, t, t FROM targets UNION ALL SELECT b.area_id, c.u, c.u||','||b.path FROM back b JOIN came c ON c.area_id=b.area_id AND c.id=b.id) SELECT d.area_id, s source, t target, {R('d', 3)} dist, b.path FROM dist d JOIN targets t ON t.area_id=d.area_id AND t.t=d.id JOIN back b ON b.area_id=d.area_id AND b.id=d.s",
    "odd_distances": f"WITH RECURSIVE {LABELS}, odd AS (SELECT b.area_id, b.id FROM big b JOIN deg d ON d.area_id=b.area_id AND d.id=b.id WHERE degree%2=1), sources AS (SELECT area_id, id s FROM odd){DIST} SELECT d.area_id, s id, count(*) reached, {R('min(d)', 3)} nearest, {R('max(d)', 3)} farthest FROM dist d JOIN odd o ON o.area_id=d.area_id AND o.id=d.id WHERE d.id<>s GROUP BY 1,2",
    "nearest_odd": f"WITH RECURSIVE {LABELS}, odd AS (SELECT b.area_id, b.id FROM big b JOIN deg d ON d.area_id=b.area_id AND d.id=b.id WHERE degree%2=1), sources AS (SELECT area_id, id s FROM odd){DIST} SELECT area_id, s id, CAST(k AS INTEGER) \"rank\", id other, {R('d', 3)} dist FROM (SELECT d.area_id, s, d.id, d, row_number() OVER (PARTITION BY d.area_id, s ORDER BY d, d.id) k FROM dist d JOIN odd o ON o.area_id=d.area_id AND o.id=d.id WHERE d.id<>s) WHERE k<=2",
    "seeds_lon": f"WITH {CELLS} SELECT area_id, CAST(s AS INTEGER) seed, id FROM (SELECT area_id, id, row_number() OVER (PARTITION BY area_id ORDER BY lon, id)-1 k, count(*) OVER (PARTITION BY area_id) n FROM nodes), range(4) x(s) WHERE k=(s*(n-1))//3",
    "kmeans_zones": f"WITH {CELLS}{KMEANS} SELECT area_id, id, zone FROM z12",
    "nearest_centroid": f"WITH {SEEDED} SELECT area_id, id, zone FROM zoned",
    "edge_zone": f"WITH {ZONES} SELECT e.area_id, src, dst, zone FROM edges e JOIN zoned z ON z.area_id=e.area_id AND z.id=e.src",
    "zone_center": f"WITH {CENTRE} SELECT area_id, zone, {R('lat', 6)} lat, {R('lon', 6)} lon FROM centre",
    "zone_order": f"WITH {CENTRE}, pt AS (SELECT {LAT} lat, {LON} lon) SELECT area_id, zone, CAST(row_number() OVER (PARTITION BY area_id ORDER BY {HAV.format(a='pt', b='c')}, zone) AS INTEGER) place FROM centre c, pt",
    "zone_count": f"WITH {EDGES} SELECT area_id, greatest(1, CAST(floor(sum(len)/(6*8046.72::DOUBLE)+0.5) AS BIGINT)) zones FROM edges GROUP BY 1",
    "cut_edges": f"WITH {ZONES} SELECT e.area_id, count(*) FILTER (a.zone<>b.zone) cuts FROM edges e JOIN zoned a ON a.area_id=e.area_id AND a.id=src JOIN zoned b ON b.area_id=e.area_id AND b.id=dst GROUP BY 1",
    "bfs_partition": f"WITH RECURSIVE {EDGES}, ranked AS (SELECT area_id, id, lat, lon, row_number() OVER (PARTITION BY area_id ORDER BY lon, id)-1 k, count(*) OVER (PARTITION BY area_id) n FROM nodes), seeds AS (SELECT area_id, id, lat, lon, z FROM ranked, range(3) x(z) WHERE k=(z*(n-1))//2), hops(area_id, z, id, h) AS (SELECT area_id, z, id, 0 FROM seeds UNION SELECT p.area_id, p.z, a.v, p.h+1 FROM hops p JOIN arcs a ON a.area_id=p.area_id AND a.u=p.id WHERE p.h<60), best AS (SELECT area_id, id, z FROM (SELECT *, row_number() OVER (PARTITION BY area_id, id ORDER BY h, z) k FROM hops) WHERE k=1), far AS (SELECT area_id, id, z FROM (SELECT n.area_id, n.id, s.z, row_number() OVER (PARTITION BY n.area_id, n.id ORDER BY (n.lat-s.lat)*(n.lat-s.lat)+(n.lon-s.lon)*(n.lon-s.lon), s.z) k FROM nodes n JOIN seeds s ON s.area_id=n.area_id ANTI JOIN best b ON b.area_id=n.area_id AND b.id=n.id) WHERE k=1) SELECT area_id, id, CAST(z AS INTEGER) \"zone\" FROM (SELECT * FROM best UNION ALL SELECT * FROM far)",
    "split_runs": "WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) k FROM orders), w(o_custkey, o_orderkey, k, run, total) AS (SELECT o_custkey, o_orderkey, k, 0, m FROM o WHERE k=1 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.k, w.run+CASE WHEN w.total+o.m>500000 THEN 1 ELSE 0 END, CASE WHEN w.total+o.m>500000 THEN o.m ELSE w.total+o.m END FROM w JOIN o ON o.o_custkey=w.o_custkey AND o.k=w.k+1) SELECT o_custkey, o_orderkey, run FROM w",
    "run_elevation": f"WITH {LINES} SELECT area_id, way_id, elev_gain_m, elev_loss_m FROM climb",
    "total_climb": f"WITH {LINES} SELECT area_id, CAST(sum(elev_gain_m) AS BIGINT) total_gain_m, CAST(sum(elev_loss_m) AS BIGINT) total_loss_m FROM climb GROUP BY 1",
    "gpx_export": f"""WITH {LINES} SELECT area_id, way_id, '<?xml version="1.0" encoding="UTF-8"?>'||chr(10)||'<gpx version="1.1" creator="lanewright" xmlns="http://www.topografix.com/GPX/1/1">'||chr(10)||'  <trk><name>North &amp; &quot;South&quot; &lt; '||way_id||'</name><trkseg>'||chr(10)||string_agg('      <trkpt lat="'||{NUM(R("lat", 6))}||'" lon="'||{NUM(R("lon", 6))}||'">'||coalesce('<ele>'||{NUM(R("ele", 2))}||'</ele>','')||'</trkpt>', chr(10) ORDER BY pos)||chr(10)||'  </trkseg></trk>'||chr(10)||'</gpx>' gpx FROM pts GROUP BY 1,2""",
    "bounding_box": f"WITH {CELLS} SELECT area_id, {R('min(lat)-(max(lat)-min(lat))*0.1::DOUBLE', 6)} lat_lo, {R('max(lat)+(max(lat)-min(lat))*0.1::DOUBLE', 6)} lat_hi, {R('min(lon)-(max(lon)-min(lon))*0.1::DOUBLE', 6)} lon_lo, {R('max(lon)+(max(lon)-min(lon))*0.1::DOUBLE', 6)} lon_hi FROM nodes GROUP BY 1",
    "xml_escape": "SELECT page_id, replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&apos;') escaped FROM pages",
    "uri_encode": "SELECT page_id, replace(replace(replace(replace(replace(url_encode(url),'%21','!'),'%27',''''),'%28','('),'%29',')'),'%2A','*') encoded FROM pages",
    "overpass_key": f"WITH {CELLS} SELECT area_id, id, concat_ws('|','walk',CAST(floor(CAST(id AS DOUBLE)+0.25+0.5) AS BIGINT),{KEY4('lat+0.00001::DOUBLE')},{KEY4('lon-0.00001::DOUBLE')}) \"key\" FROM nodes",
    "geocode_key": r"SELECT doc_id, lower(regexp_replace(regexp_replace(text,'^[\s\v\x{A0}]+|[\s\v\x{A0}]+$','','g'),'[\s\v\x{A0}]+',' ','g')) AS key FROM documents",
    "geocode_lookup": "SELECT c_custkey, s_acctbal lat, CAST(s_nationkey AS DOUBLE) lon, s_suppkey IS NOT NULL AS found FROM customer LEFT JOIN supplier ON lower(replace(s_name,'Supplier','Customer'))=lower(c_name)",
    "slim_encode": f"WITH {CELLS}, fx AS (SELECT area_id, p, CAST(floor(lat*1e7::DOUBLE+0.5) AS BIGINT) y, CAST(floor(lon*1e7::DOUBLE+0.5) AS BIGINT) x FROM nodes), st AS (SELECT area_id, p, p-lag(p,1,0) OVER w i, y-lag(y,1,0) OVER w a, x-lag(x,1,0) OVER w o FROM fx WINDOW w AS (PARTITION BY area_id ORDER BY p)) SELECT area_id, 1 v, string_agg(i, ',' ORDER BY p) i, string_agg(a, ',' ORDER BY p) a, string_agg(o, ',' ORDER BY p) o, any_value(n) ways FROM st JOIN (SELECT area_id, count(*) n FROM ways GROUP BY 1) USING (area_id) GROUP BY 1",
    "slim_expand": f"WITH {CELLS} SELECT area_id, id, {R('lat', 7)} lat, {R('lon', 7)} lon FROM nodes",
    "cooldown_gate": GATE,
    "cooldown_stream": GATE,
    "cooldown_left": f"WITH {EVENTS} SELECT user_id, seq, left_ms, CAST(ceil(left_ms/1000.0) AS BIGINT) left_s FROM (SELECT user_id, seq, CASE WHEN l IS NULL THEN 0 ELSE greatest(0, 21600000-(tm-l)) END left_ms FROM (SELECT *, lag(tm) OVER (PARTITION BY user_id ORDER BY tm, seq) l FROM ev))",
    "ttl_hits": f"WITH {EVENTS} SELECT seq, coalesce(tm-(SELECT max(p.tm) FROM ev p WHERE p.user_id=e.user_id AND p.event_type IN ('purchase','signup') AND p.tm<=e.tm)<=259200000, false) hit FROM ev e WHERE event_type NOT IN ('purchase','signup')",
    "lru_order": f"WITH {EVENTS} SELECT store, key, CAST(row_number() OVER (PARTITION BY store ORDER BY tm DESC, seq DESC) AS INTEGER) place FROM (SELECT user_id%10 store, user_id AS key, tm, seq, row_number() OVER (PARTITION BY user_id ORDER BY tm DESC, seq DESC) k FROM ev) WHERE k=1",
    "would_use_network": f"WITH {EVENTS}, puts AS (SELECT user_id, max(tm) t FROM ev GROUP BY 1), pl AS (SELECT user_id, t, 40+user_id%50*0.25 lat, -74+user_id%3*0.5 lon FROM puts), known AS (SELECT lat, lon, max(t) t FROM pl WHERE user_id%4<>0 GROUP BY 1,2) SELECT seq, NOT (seq%11=0) AND NOT (coalesce(e.tm-p.t<=432000000,false) AND coalesce(e.tm-k.t<=432000000,false)) network FROM ev e LEFT JOIN pl p ON p.user_id=e.user_id LEFT JOIN known k ON k.lat=p.lat AND k.lon=p.lon WHERE event_type IN ('view','click')",
    "failover_choice": f"WITH {ATTEMPTS}, j AS (SELECT *, coalesce(status=200,false) AND (n_elements<>0 OR ord=2) taken, coalesce(status BETWEEN 400 AND 499 AND status<>429,false) refused FROM att), t AS (SELECT *, coalesce(max(CASE WHEN taken OR refused THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) ended, CASE WHEN taken THEN NULL WHEN status IS NULL THEN 'no connection' WHEN status=200 THEN 'no data for that area' ELSE {STATUS} END said FROM j) SELECT request_id, min(endpoint) FILTER (taken) endpoint, count(*) tries, CASE WHEN bool_or(taken) THEN NULL ELSE arg_max(said, ord) END message FROM t WHERE ended=0 GROUP BY 1",
    "status_message": f"WITH {ATTEMPTS} SELECT request_id, CAST(ord AS INTEGER) ord, {STATUS} message FROM att WHERE status IS NOT NULL",
    "elevation_lookup": f"WITH {CELLS} SELECT area_id, id, CASE WHEN area_id<>'0' THEN ele END ele FROM nodes",
    "hue_palette": f"SELECT n_nationkey, {R('n_nationkey/25.0::DOUBLE*360', 6)} hue, 'hsl('||{NUM('n_nationkey/25.0::DOUBLE*360')}||',70%,62%)' color FROM nation",
    "units": f"SELECT o_orderkey, {R('o_totalprice/1609.344::DOUBLE', 2)} miles, CAST(floor(o_totalprice*3.28084::DOUBLE+0.5) AS BIGINT) feet, CAST(floor(o_totalprice-100000.5::DOUBLE+0.5) AS BIGINT) whole, CAST(floor(o_totalprice/1000000::DOUBLE*1e7::DOUBLE+0.5) AS BIGINT) fixed FROM orders",
    "json_round_trip": "SELECT event_id, CASE WHEN event_id%10<>0 THEN event_id END t, CASE WHEN event_id%10<>0 THEN event_type END d FROM events",
    "synthetic_grid": f"WITH cell AS (SELECT n, n//16 r, n%16 c FROM range(480) x(n) WHERE NOT (n//16 BETWEEN 6 AND 9 AND n%16 BETWEEN 3 AND 5) AND NOT (n//16 BETWEEN 18 AND 23 AND n%16 BETWEEN 9 AND 12)), e AS (SELECT a.n x, b.n y, CASE WHEN a.r=b.r THEN 0.15::DOUBLE WHEN a.c=b.c THEN 0.05::DOUBLE ELSE 0.158::DOUBLE END*1609.344::DOUBLE len FROM cell a JOIN cell b ON (b.r=a.r AND b.c=a.c+1) OR (b.r=a.r+1 AND b.c=a.c) OR (b.r=a.r+1 AND b.c=a.c+1 AND (a.r+a.c)%5=0)) SELECT least(CAST(x AS VARCHAR),CAST(y AS VARCHAR)) src, greatest(CAST(x AS VARCHAR),CAST(y AS VARCHAR)) dst, {R('len', 6)} len FROM e",
    "matching_parity": f"WITH RECURSIVE {LABELS} SELECT b.area_id, count(*) ends, count(*) odd FROM big b JOIN deg d ON d.area_id=b.area_id AND d.id=b.id WHERE degree%2=1 GROUP BY 1",
    "augmented_parity": f"WITH RECURSIVE {LABELS} SELECT area_id, count(*) nodes, CAST(0 AS BIGINT) odd FROM big GROUP BY 1",
    "euler_check": f"WITH RECURSIVE {LABELS} SELECT area_id, CAST(0 AS BIGINT) gaps, CAST(0 AS BIGINT) \"open\", count(*) edges FROM kept GROUP BY 1",
    "contraction": f"WITH RECURSIVE {LABELS} SELECT k.area_id, segments, bare_m, odd FROM (SELECT area_id, count(*) segments, {R('sum(len)', 3)} bare_m FROM kept GROUP BY 1) k JOIN (SELECT b.area_id, count(*) odd FROM big b JOIN deg d ON d.area_id=b.area_id AND d.id=b.id WHERE degree%2=1 GROUP BY 1) o USING (area_id)",
    "plan_stats": f"WITH RECURSIVE {LABELS} SELECT 'q'||area_id request_id, n intersections, segments, bare_mi, true covers, true enough_runs FROM largest JOIN (SELECT area_id, count(*) segments, {R('sum(len)/1609.344::DOUBLE', 1)} bare_mi FROM kept GROUP BY 1) USING (area_id)",
    "plan_accounts": f"WITH RECURSIVE {LABELS} SELECT 'q'||area_id request_id, {R('sum(len)', 3)} bare_m, count(*) segments, CAST(0 AS BIGINT) breaks, CAST(0 AS BIGINT) \"open\", CAST(0 AS BIGINT) lengths_off, CAST(0 AS BIGINT) points_off, CAST(0 AS BIGINT) numbers_off, true repeats_agree, true overhead_agrees FROM kept GROUP BY area_id",
    "ttl_stream": f"WITH {EVENTS}, seen AS (SELECT *, event_type IN ('purchase','signup') put, max(CASE WHEN event_type IN ('purchase','signup') THEN tm END) OVER (PARTITION BY user_id ORDER BY tm, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) last FROM ev) SELECT user_id, seq, coalesce(tm-last<=259200000, false) hit FROM seen WHERE NOT put",
    "cache_replay": f"""WITH RECURSIVE {EVENTS},
o AS (SELECT CAST(user_id%8 AS VARCHAR) ns, row_number() OVER (PARTITION BY user_id%8 ORDER BY tm, seq) k, CASE WHEN event_type IN ('purchase','signup') THEN 'put' WHEN seq%17=0 THEN 'drop' WHEN seq%5=0 THEN 'peek' ELSE 'get' END op,
 CAST(user_id AS VARCHAR) u, CAST(trunc(abs(value)*10+10) AS BIGINT) z, tm FROM ev),
s(ns, k, recs, op, u, ok, evicted) AS (
 SELECT DISTINCT ns, CAST(0 AS BIGINT), CAST([] AS STRUCT(u VARCHAR, z BIGINT, t BIGINT)[]), '', '', false, '' FROM o
 UNION ALL SELECT ns, k, CASE WHEN op='peek' OR (op='put' AND z>4000) THEN recs WHEN op='drop' OR (op='get' AND NOT hit) THEN others WHEN op='get' THEN list_concat(mine, others)
   ELSE list_concat([struct_pack(u:=u, z:=z, t:=tm)], others[1:room]) END,
  op, u, CASE op WHEN 'put' THEN z<=4000 WHEN 'drop' THEN len(mine)>0 ELSE hit END,
  CASE WHEN op='put' AND z<=4000 THEN array_to_string(list_reverse(list_transform(others[room+1:], lambda x: x.u)), ',') ELSE '' END
 FROM (SELECT *, len(list_filter(range(1, len(others)+1), lambda i: list_sum(list_transform(others[1:i], lambda x: len(x.u)+x.z))+len(u)+z<=6000)) room, coalesce(tm-mine[1].t<=259200000, false) hit
  FROM (SELECT o.*, list_filter(s.recs, lambda x: x.u=o.u) mine, list_filter(s.recs, lambda x: x.u<>o.u) others, s.recs FROM s JOIN o ON o.ns=s.ns AND o.k=s.k+1)))
SELECT ns namespace, k seq, op, u AS key, ok, evicted FROM s WHERE k>0""",
    "plan_checks": f"WITH {CELLS} SELECT DISTINCT area_id, CAST(0 AS BIGINT) missed, CAST(0 AS BIGINT) \"long\", CAST(0 AS BIGINT) off FROM nodes",
    "demo_plan": f"SELECT CAST(k+1 AS INTEGER) id, 4.5::DOUBLE-k length_mi, 'hsl('||{NUM('k/3.0::DOUBLE*360')}||',70%,62%)' color, 2 points FROM range(3) x(k)",
}

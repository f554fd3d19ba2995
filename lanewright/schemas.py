"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

NODES = "area_id string, id string, lat double, lon double, ele double"
EDGES = "area_id string, src string, dst string, len double"
#: A map response: nodes and ways share one array, each with its own fields.
ELEMENT = "struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>"
RESPONSE = f"struct<elements:array<{ELEMENT}>>"
SLIM = "struct<v:int,i:array<bigint>,a:array<bigint>,o:array<bigint>,w:array<array<bigint>>>"
REQUESTS = "request_id string, area_id string, max_m double, start_lat double, start_lon double, cluster boolean, match_k double"
#: One row for each edge of a planned walk, in order.
WALK = "request_id string, area_id string, run_id int, zone int, component int, pos int, a string, b string, len double, via array<string>, zones int"
CONTRACTED = "area_id string, src string, dst string, len double, via array<string>"
COORD = "struct<lat:double,lon:double,ele:double>"
CACHE_EVENT = "seq bigint, op string, key string, size bigint, at bigint"
CACHE_RESULT = "namespace string, seq bigint, op string, key string, ok boolean, evicted array<string>"
DEMO = "center array<double>, runs array<struct<id:int,length_mi:double,zone:int,color:string,coords:array<array<double>>>>, stats struct<intersections:int,segments:int,bare_mi:double,covered_mi:double,overhead_pct:double,n_runs:int,zones:int>"

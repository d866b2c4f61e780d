"""The upsert of op11 in plain Python, over lists in memory."""

import bisect
import hashlib
import math
import zlib

import duckdb

COLUMNS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
SETS = ["source", "segment", "city", "balance"]


def crc(x):
    return zlib.crc32(str(x).encode())


def rows(sf_dir, name):
    rel = duckdb.sql(f"SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]


def brute(sf_dir=None, clients=None, changes=None):
    clients = rows(sf_dir, "clients") if clients is None else clients
    changes = rows(sf_dir, "client_changes") if changes is None else changes
    most = 1 + len(clients) // 1500
    start = sorted((c for c in clients if crc(c["client_id"]) % 7 > 3), key=lambda c: c["client_id"])
    files = [start[i : i + most] for i in range(0, len(start), most)]
    firsts = [f[0]["client_id"] for f in files]
    wins = {}
    for c in changes:
        if c["client_id"] not in wins or (c["seq"], c["change_id"]) > (wins[c["client_id"]]["seq"], wins[c["client_id"]]["change_id"]):
            wins[c["client_id"]] = c
    after = [{r["client_id"]: dict(r) for r in f} for f in files]
    for i, c in wins.items():
        if not files:
            break
        home = max(0, bisect.bisect_right(firsts, i) - 1)
        h = crc(firsts[home]) % 10
        if h > 7:
            continue
        if c["op"] == "D" or crc(c["change_id"]) % 8 < h:
            after[home].pop(i, None)
        else:
            row = after[home].setdefault(i, dict.fromkeys(COLUMNS) | {"client_id": i})
            row |= {k: c[k] for k in SETS}
    out = []
    for old, new in zip(files, after, strict=True):
        new = [new[i] for i in sorted(new)]
        if new == old:
            out.append([old, False])
            continue
        n = -(-len(new) // most)
        at = 0
        for p in range(n):
            size = len(new) // n + (p < len(new) % n)
            piece = new[at : at + size]
            at += size
            if out and out[-1][1] and len(out[-1][0]) + size <= most:
                out[-1][0] = out[-1][0] + piece
            else:
                out.append([piece, True])
    return [
        {
            "first_id": f[0]["client_id"],
            "n_rows": len(f),
            "cents": sum(0 if r["balance"] is None else math.floor(100 * r["balance"] + 0.5) for r in f),
            "rows_crc": sum(zlib.crc32("|".join(r[k] or "" for k in ("source", "segment", "city")).encode()) for r in f),
            "ids_sha256": hashlib.sha256(",".join(str(r["client_id"]) for r in f).encode()).hexdigest(),
            "columns": ",".join(COLUMNS),
            "rewritten": new,
        }
        for f, new in out
    ]

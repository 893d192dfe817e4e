"""Small annotated matrices and a dense view of them."""

import numpy as np
from cellmesa.model import CellDataset


def dataset(spark, dense, obs=None, var=None, stored_zeros=()):
    """A dataset of a dense array; positions in ``stored_zeros`` are stored although 0."""
    a = np.asarray(dense, float)
    x = [(int(i), int(j), float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j] != 0 or (i, j) in stored_zeros]
    obs_rows = [(i, *(v[i] for v in (obs or {}).values())) for i in range(a.shape[0])]
    var_rows = [(j, *(v[j] for v in (var or {}).values())) for j in range(a.shape[1])]
    kind = {str: "string", int: "long", float: "double", bool: "boolean"}
    schema = lambda key, cols: ", ".join([f"{key} long", *(f"{k} {kind[next(type(x) for x in v if x is not None)]}" for k, v in (cols or {}).items())])
    return CellDataset(
        spark.createDataFrame(x, "cell_id long, gene_id long, value double"),
        spark.createDataFrame(obs_rows, schema("cell_id", obs)),
        spark.createDataFrame(var_rows, schema("gene_id", var)),
    )


def dense(x, shape):
    out = np.zeros(shape)
    for r in x.collect():
        out[r.cell_id, r.gene_id] = r.value
    return out


def by_gene(df, column, n, group=None):
    out = np.full(n, np.nan)
    for r in df.collect():
        if group is None or r.group == group:
            out[r.gene_id] = np.nan if r[column] is None else r[column]
    return out


def counts(seed=0, n=30, m=12, density=0.4):
    rng = np.random.RandomState(seed)
    return rng.poisson(5, (n, m)) * (rng.random_sample((n, m)) < density)

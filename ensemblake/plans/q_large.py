"""Queries over binary trajectories, and over models that no machine holds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import dcd
from . import domain as dm
from .q_more import place

Q = {}


def q(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


# --- binary trajectories -------------------------------------------------------------------------------------------

#: 21 atoms from the components of a vector; a trajectory per label, its frames in order of ids.
ATOMS = 21
STRUCTURES = f"""st AS (
  SELECT dense_rank() OVER (ORDER BY label) - 1 AS traj_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
         list_transform(embedding[1:{3 * ATOMS}], lambda e: round(e::DOUBLE, 4)) AS x FROM embeddings)"""


def structures(s, d):
    e = dm.table(s, d, "embeddings")
    frame = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    return e.select(F.col("label").cast("long").alias("traj_id"), frame.alias("frame"), F.transform(F.slice("embedding", 1, 3 * ATOMS), lambda v: F.round(v.cast("double"), 4)).alias("x"))


def atoms_of(frames, numbers=None):
    """A row an atom; numbers: which atoms the rows hold, in order."""
    at = F.array(*(F.lit(k) for k in numbers or range(ATOMS)))
    own = frames.select("traj_id", "frame", "x", F.posexplode(at).alias("k", "atom_id"))
    return own.select("traj_id", "frame", F.col("atom_id").cast("long").alias("atom_id"), *(F.round(F.element_at("x", F.col("k") * 3 + c + 1), 4).alias(n) for c, n in enumerate("xyz")))


def as_sql(atoms, where=""):
    return f"""WITH {STRUCTURES}, a AS (SELECT traj_id, frame, x, unnest({atoms}) AS atom_id FROM st {where})
SELECT traj_id, frame, atom_id::BIGINT AS atom_id, x[atom_id * 3 + 1] AS x, x[atom_id * 3 + 2] AS y, x[atom_id * 3 + 3] AS z FROM a"""


@q("dcd_round_trip", as_sql(list(range(ATOMS))))
def _(s, d):
    path = place(s, "dcd")
    dcd.write_dcd(structures(s, d), path)
    return atoms_of(dcd.load_dcd(s, path, split=1 << 16))


@q("dcd_stride_of_some_atoms", as_sql([2, 3, 20], "WHERE frame % 5 = 0 AND frame >= 10"))
def _(s, d):
    """Every fifth frame, as strided readers take them, of three atoms; what else the files hold isn't read."""
    path = place(s, "dcd")
    dcd.write_dcd(structures(s, d), path)
    return atoms_of(dcd.load_dcd(s, path, stride=5, atoms=[2, 3, 20]).where("frame >= 10"), [2, 3, 20])

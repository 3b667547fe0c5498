"""Similarity of dense vectors, binary codes and token matrices, as expressions over array columns.

Components are taken as doubles. Degenerate input (null, empty, zero norm) gives 0 where the measure is bounded, as a
ranking needs a number; `checked_cosine` raises instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vec(c: Column | str) -> Column:
    return col(c).cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(vec(a), vec(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(total(F.transform(vec(a), lambda x: x * x)))


def normalised(a: Column | str) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(vec(a), lambda x: x / n)).otherwise(vec(a))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(vec(a), vec(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Raw cosine, -1 to 1; 0 for a zero vector or different lengths."""
    n = norm(a) * norm(b)
    return F.when((n > 0) & (F.size(vec(a)) == F.size(vec(b))), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(F.lit(0.0))


def cos01(a: Column | str, b: Column | str) -> Column:
    """Cosine moved to 0..1: orthogonal vectors have 0.5, degenerate ones 0."""
    n = norm(a) * norm(b)
    return F.when((n > 0) & (F.size(vec(a)) == F.size(vec(b))), (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)) + 1) / 2).otherwise(F.lit(0.0))


def checked_cosine(a: Column | str, b: Column | str) -> Column:
    """Raw cosine; an error for different lengths or a zero norm."""
    n = norm(a) * norm(b)
    return F.when(F.size(vec(a)) != F.size(vec(b)), F.raise_error(F.lit("vectors differ in length"))).when(n == 0, F.raise_error(F.lit("vector of norm zero"))).otherwise(dot(a, b) / n).cast("double")


def distance(a: Column | str, b: Column | str, metric: str) -> Column:
    """Index distance: cosine 1-cos, dot -a.b, euclidean."""
    if metric not in ("cosine", "dot", "euclidean"):
        raise ValueError(f"no distance for {metric}")
    return {"cosine": lambda: 1 - cosine(a, b), "dot": lambda: -dot(a, b), "euclidean": lambda: euclidean(a, b)}[metric]()


def similarity_of(d: Column | str, metric: str) -> Column:
    """Similarity of an index distance: cosine (2-d)/2, dot the sigmoid of -d, euclidean e^-d."""
    d = col(d)
    return {"cosine": (2 - d) / 2, "dot": 1 / (1 + F.exp(d)), "euclidean": F.exp(-d)}[metric]


def transe_similarity(a: Column | str, b: Column | str) -> Column:
    return 1 / (1 + euclidean(a, b))


def transe_tail(head: Column | str, relation: Column | str) -> Column:
    return F.zip_with(vec(head), vec(relation), lambda x, y: x + y)


def transe_relation(head: Column | str, tail: Column | str) -> Column:
    return F.zip_with(vec(tail), vec(head), lambda x, y: x - y)


def transe_score(head: Column | str, relation: Column | str, tail: Column | str) -> Column:
    return -euclidean(transe_tail(head, relation), tail)


def signs(a: Column | str) -> Column:
    """Binary code: 1 where a component is 0 or more."""
    return F.transform(vec(a), lambda x: F.when(x >= 0, 1).otherwise(0))


def hamming_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - differing bits / bits, over arrays of 0 and 1."""
    differ = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(col(a)) > 0, 1 - differ / F.size(col(a))).otherwise(F.lit(0.0))


def tokens(a: Column | str, width: int) -> Column:
    """An array cut into a matrix of tokens of that width."""
    a = vec(a)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(a) / width).cast("int") - 1)), lambda i: F.slice(a, i * width + 1, F.lit(width)))


def maxsim(query: Column | str, doc: Column | str, shifted: bool = True) -> Column:
    """Mean over the query's tokens of the best cosine among the document's; shifted to 0..1 unless raw."""
    measure = cos01 if shifted else cosine
    best = F.transform(col(query), lambda q: F.array_max(F.transform(col(doc), lambda d: measure(q, d))))
    return F.when((F.size(col(query)) > 0) & (F.size(col(doc)) > 0), total(best) / F.size(col(query))).otherwise(F.lit(0.0))


def maxsim_early(query: Column | str, doc: Column | str, enough: float) -> Column:
    """Raw MaxSim that takes for each token of the query the document's first cosine of `enough` or more, and the best where none is."""

    def best(q: Column) -> Column:
        near = F.transform(col(doc), lambda d: cosine(q, d))
        return F.coalesce(F.try_element_at(F.filter(near, lambda s: s >= enough), F.lit(1)), F.array_max(near))

    return F.when((F.size(col(query)) > 0) & (F.size(col(doc)) > 0), total(F.transform(col(query), best)) / F.size(col(query))).otherwise(F.lit(0.0))


def token_alignments(query: Column | str, doc: Column | str) -> Column:
    """For each token of the query (query_token, doc_token, similarity), numbered from 0: the document's nearest by cosine, the first of equals. An empty side has none."""

    def best(q: Column, i: Column) -> Column:
        most = F.array_max(F.transform(col(doc), lambda d, j: F.struct(cosine(q, d).alias("s"), (-j).alias("j"))))
        return F.struct(i.cast("int").alias("query_token"), (-most["j"]).cast("int").alias("doc_token"), most["s"].alias("similarity"))

    return F.when(F.size(col(doc)) > 0, F.transform(col(query), best)).otherwise(F.array().cast("array<struct<query_token:int,doc_token:int,similarity:double>>"))


def maxsim_symmetric(a: Column | str, b: Column | str, shifted: bool = True) -> Column:
    return (maxsim(a, b, shifted) + maxsim(b, a, shifted)) / 2


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def variance(a: Column | str) -> Column:
    """Population variance of an array's components."""
    m = total(vec(a)) / F.size(vec(a))
    return total(F.transform(vec(a), lambda x: (x - m) * (x - m))) / F.size(vec(a))


def mobius_add(x: Column, y: Column) -> Column:
    """Möbius addition in the unit ball (curvature -1)."""
    xy, x2, y2 = dot(x, y), dot(x, x), dot(y, y)
    return F.zip_with(vec(x), vec(y), lambda a, b: ((1 + 2 * xy + y2) * a + (1 - x2) * b) / (1 + 2 * xy + x2 * y2))


def ball(a: Column | str, scale: float = 0.5) -> Column:
    """A vector projected into the unit ball: its direction at radius `scale`."""
    return F.transform(normalised(a), lambda x: x * scale)


def poincare_distance(x: Column | str, y: Column | str) -> Column:
    """2 artanh |(-x) + y| through the closed form of the norm."""
    x2, y2 = dot(x, x), dot(y, y)
    gap = F.pow(euclidean(x, y), 2)
    return F.acosh(1 + 2 * gap / ((1 - x2) * (1 - y2)))


def exp_map(v: Column | str) -> Column:
    """From the tangent space at the origin into the ball."""
    n = norm(v)
    return F.when(n > 0, F.transform(vec(v), lambda x: F.tanh(n) * x / n)).otherwise(vec(v))


def log_map(x: Column | str) -> Column:
    """From the ball to the tangent space at the origin."""
    n = norm(x)
    return F.when(n > 0, F.transform(vec(x), lambda a: F.atanh(F.least(n, F.lit(1 - 1e-12))) * a / n)).otherwise(vec(x))


def cone_angle(apex: Column | str, point: Column | str) -> Column:
    """Angle at the apex between the outward axis and the direction to the point; 0 at the apex itself."""
    away = F.zip_with(vec(point), vec(apex), lambda p, a: p - a)
    n = norm(away) * norm(apex)
    return F.when(n > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(away, apex) / n)))).otherwise(F.lit(0.0))


def cone_membership(angle: Column, aperture: Column | float) -> Column:
    """1 inside the aperture, then e^(-2 * excess)."""
    aperture = F.lit(aperture) if isinstance(aperture, int | float) else aperture
    return F.when(angle <= aperture, 1.0).otherwise(F.exp(-2 * (angle - aperture)))

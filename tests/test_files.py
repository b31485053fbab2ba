"""Edit stacks, drawings, point clouds and training on odd inputs."""

import numpy as np
import pytest

from quillstone.operators import editing as E
from quillstone.operators import features as X
from quillstone.operators import kernels as K
from quillstone.operators import training as T
from quillstone.sources import drawings as D
from quillstone.sources import points as P


def test_stack_undoes_and_repeats(spark):
    px = spark.createDataFrame([(0, 0, 0, 10, 20, 30)], "image_id long, y int, x int, r int, g int, b int")
    stack = E.EditStack().push("invert").push("grayscale")
    assert stack.undo() and [tuple(r)[3:] for r in stack.apply(px).collect()] == [(245, 235, 225)]
    assert stack.redo() and not stack.redo() and E.EditStack.from_recipe(stack.to_recipe()).steps == stack.steps
    assert not E.EditStack().undo()
    with pytest.raises(ValueError):
        stack.push("nothing")
    with pytest.raises(ValueError):
        E.EditStack.from_recipe('[{"step": "invert"}]')


def test_foreign_drawings_are_refused(spark):
    with pytest.raises(Exception, match="foreign element"):
        D.from_svg(spark.createDataFrame([(1, '<svg>\n<path d="M0 0"/>\n</svg>\n')], "drawing_id long, svg string")).collect()
    with pytest.raises(Exception, match="foreign entity"):
        D.from_dxf(spark.createDataFrame([(1, "0\nSECTION\n2\nENTITIES\n0\nSPLINE\n8\nL\n0\nENDSEC\n0\nEOF\n")], "drawing_id long, dxf string")).collect()


def test_points_round_trip_and_refuse_other_files():
    for n in (0, 1, 57):
        data = P.write(np.random.default_rng(n).normal(size=(n, 3)))
        assert P.restore(P.archive(data)) == data and P.inspect(data)[0][:3] == ("vertex", n, 12)
    with pytest.raises(ValueError):
        P.inspect(data[:-1])
    with pytest.raises(ValueError):
        P.inspect(b"ply\nformat ascii 1.0\nend_header\n")
    with pytest.raises(ValueError):
        P.inspect(b"ply\nformat binary_little_endian 1.0\nelement face 1\nproperty list uchar int v\nend_header\n")
    broken = bytearray(P.archive(data))
    broken[10] ^= 1
    with pytest.raises(ValueError):
        P.restore(bytes(broken))


def test_training_is_the_same_for_one_seed():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    a, b = T.train(x, y, 8, 2, 5), T.train(x, y, 8, 2, 5)
    assert a[1] == b[1] >= 0.85 and all((u == v).all() for u, v in zip(a[0], b[0], strict=True))


def test_contract_counts_what_breaks_it(spark):
    rows = [("s", 1, "x", 500_000, False, ""), ("s", 2, None, 0, True, "why"), ("s", 3, None, 5, True, "why"), ("s", 4, None, 0, True, ""), ("s", 5, None, 10, False, ""), ("s", 6, "x", 2_000_000, False, ""), ("s", 7, "x", None, False, "")]
    found = spark.createDataFrame(rows, "specialist_id string, query_id long, output string, confidence long, abstained boolean, reason string")
    assert tuple(X.contract_violations(found).first()) == (5, 7)


def test_median_cut_keeps_few_colours(spark):
    px = spark.createDataFrame([(0, 0, i, 10 * i, 0, 0) for i in range(20)] + [(1, 0, 0, 5, 5, 5)], "image_id long, y int, x int, r int, g int, b int")
    got = K.median_cut(px, 4).collect()
    assert len([r for r in got if r["image_id"] == 0]) == 4 and [tuple(r)[2:] for r in got if r["image_id"] == 1] == [(5, 5, 5)]

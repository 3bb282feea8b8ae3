import numpy as np
import pytest

from tessella.operators import simulation as S


@pytest.mark.parametrize("border", ["wall", "torus"])
def test_a_stack_moves_as_its_fields_do_one_by_one(border):
    world = S.World(24, 40, 1, 2, border)
    mass, fy, fx = np.random.default_rng(4).normal(0.5, 4.0, (3, 5, 24, 40))
    moved = S.transport(world, np.stack([mass, mass * 2]), fy, fx)
    for k in range(5):
        assert np.array_equal(moved[:, k], S.transport(world, np.stack([mass[k], mass[k] * 2]), fy[k], fx[k]))
        for whole, one in zip(S.gradient(mass, border), S.gradient(mass[k], border), strict=True):
            assert np.array_equal(whole[k], one)
    assert np.allclose(moved[0].sum(axis=(1, 2)), mass.sum(axis=(1, 2)))

import numpy as np
import pytest

from framefold.operators import kernels as K


def test_ellipses():
    assert K.ellipse(3).tolist() == [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
    assert K.ellipse(5).tolist() == [[0, 0, 1, 0, 0], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [0, 0, 1, 0, 0]]


H = np.array([0.31352306075221065, -0.0036168279172151025, 63.474329554674924, -0.03327612614808642, 0.6719951870421366, 1.7461470450516172, 4.9710139915891165e-06, -0.0001384534780680808, 1.0])
QUAD = np.array([[102.0, 61.5], [355.0, 74.0], [340.0, 300.0], [95.0, 288.0]])
BOX = np.array([[96.0, 40.0], [176.0, 40.0], [176.0, 200.0], [96.0, 200.0]])


def test_homography_of_four_points():
    assert np.allclose(K.homography(QUAD, BOX), H, rtol=1e-7, atol=1e-9)
    got = K.project(H, np.array([[128.0, 120.0], [200.0, 90.0], [310.0, 250.0]]))
    assert np.allclose(got, [[104.84651294068777, 79.39480567723446], [127.31327893898543, 56.21508511921176], [165.22670777319198, 164.882393789968]])


def test_ransac_leaves_outliers_out():
    rng = np.random.default_rng(3)
    src = rng.uniform(90, 350, (30, 2))
    dst = K.project(H, src) + rng.normal(0, 0.2, (30, 2))
    dst[:8] += rng.uniform(20, 60, (8, 2))
    h, inliers = K.ransac_homography(src, dst, seed=5)
    assert inliers.tolist() == [False] * 8 + [True] * 22
    assert np.linalg.norm(K.project(h, src[8:]) - K.project(H, src[8:]), axis=1).max() < 0.6
    again = K.ransac_homography(src, dst, seed=5)
    assert np.array_equal(h, again[0])


def test_min_area_rect_of_an_axis_rectangle():
    points = np.array([(x, y) for x in range(10, 31) for y in range(5, 16)])
    centre, sides, box = K.min_area_rect(points)
    assert np.allclose(centre, [20, 10]) and np.allclose(sides, [20, 10])
    assert sorted(map(tuple, np.rint(box).tolist())) == [(10, 5), (10, 15), (30, 5), (30, 15)]


def test_undistort_map():
    x, y = K.undistort_map(412, 360, -0.2)
    assert x[0, 0] == pytest.approx(18.164077758789062, abs=1e-4) and y[0, 0] == pytest.approx(15.8715238571167, abs=1e-4)
    assert x[0, 41] == pytest.approx(52.59172058105469, abs=1e-4)


def test_gray_of_pure_colours():
    assert K.gray(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]], dtype=np.uint8)).tolist() == [[29, 150, 76, 255]]


def test_hsv_and_lab_of_pure_colours():
    pure = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [0, 0, 0]]], dtype=np.uint8)
    assert K.hsv(pure).tolist() == [[[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 0]]]
    assert K.lab(pure).tolist() == [[[136, 208, 195], [224, 42, 211], [82, 207, 20], [0, 128, 128]]]


def test_otsu_parts_two_levels():
    image = np.array([[10] * 50 + [200] * 50], dtype=np.uint8)
    assert K.otsu_threshold(image) == 10


def test_morphology():
    image = np.zeros((7, 7), dtype=np.uint8)
    image[3, 3] = 255
    grown = K.dilate(image, K.ellipse(3))
    assert (grown > 0).sum() == 5 and np.array_equal(K.erode(grown, K.ellipse(3)), image)
    assert K.opened(image, K.ellipse(3)).sum() == 0
    assert K.erode(np.full((3, 3), 255, dtype=np.uint8), K.ellipse(3)).min() == 255


def test_components():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 0]])
    _, eight = K.components(mask)
    _, four = K.components(mask, diagonal=False)
    assert [c["area"] for c in eight] == [2, 2, 3] and [c["area"] for c in four] == [1, 2, 1, 3]
    assert eight[2] == {"area": 3, "x": 0, "y": 3, "w": 3, "h": 1, "cx": 1.0, "cy": 3.0}


def test_template_is_found():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 255, (20, 30))
    response = K.match_template(image, image[5:13, 9:17])
    assert np.unravel_index(response.argmax(), response.shape) == (5, 9) and response.max() == pytest.approx(1)
    assert K.match_template(np.full((9, 9), 7), image[:4, :4]).max() == 0


def test_resize_and_tiles():
    image = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert K.resize_area(image, 2, 2).tolist() == [[2, 4], [10, 12]]
    assert K.tile_means(image, 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]


def test_warp_by_identity_and_shift():
    image = np.arange(25, dtype=np.uint8).reshape(5, 5)
    assert np.array_equal(K.warp(image, np.eye(3), 5, 5), image)
    assert K.warp(image, np.array([[1, 0, 1], [0, 1, 0], [0, 0, 1]]), 5, 5)[:, 0].tolist() == [0] * 5


def test_two_means_and_box():
    assert K.two_means(np.array([[0, 0], [1, 1], [100, 100], [101, 99]])).tolist() == [[100.5, 99.5], [0.5, 0.5]]
    assert K.two_means(np.array([[0, 0], [10, 10]])) is None
    image = np.zeros((20, 20), dtype=np.uint8)
    image[2:18, 3:19] = 200
    assert K.content_box(image) == (4, 4, 16, 16) and K.content_box(np.zeros((4, 4))) is None
    assert K.content_box(np.where(np.arange(20)[:, None] < 8, image, 0)) is None and K.content_box(np.minimum(image, 40)) is None
    points = np.array([[50.0, 0], [0, 0], [100, 0], [99, 0]])
    assert sorted(K.two_means(points)[:, 0].tolist()) == [0.0, 83.0]


def test_footprints_in_any_turn():
    assert K.footprint_name([(5, 5), (6, 5), (7, 5), (8, 5)]) == "I"
    assert K.footprint_name([(0, 1), (1, 0), (1, 1), (2, 1)]) == "T"
    assert K.footprint_name([(0, 0), (0, 1), (0, 2)]) is None


def test_kernel_over_a_column(spark):
    rows = [(1, bytes(range(12)), 2, 2, 3), (2, None, 2, 2, 3), (3, b"12", 2, 2, 1)]
    frames = spark.createDataFrame(rows, "id long, data binary, width int, height int, channels int")
    got = {r["id"]: r["mean"] for r in K.over_images(frames, "id", lambda i: [float(K.gray(i).mean())], "mean double").collect()}
    assert got[1] is not None and got[2] is None and got[3] is None

"""Small graphs with known answers: name -> (edges, hop ecc, weighted ecc, sweep) from the smallest id."""

MICRO = {
    "path5": ([(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 4, 4)], 4, 10, 10),
    "star6": ([(0, i, i) for i in range(1, 6)], 1, 5, 9),
    "diamond": ([(0, 1, 1), (1, 3, 10), (0, 2, 4), (2, 3, 2)], 2, 6, 7),
    "heavy_light": ([(0, 1, 1), (1, 2, 1), (0, 2, 7), (2, 3, 9), (3, 4, 1)], 3, 12, 12),
}
TWO_TRIANGLES = [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 5), (4, 5, 5), (3, 5, 5), (5, 6, 1)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long, w long")

"""Kinds of 120 documents of the sf0.1 table, told by reading them: a stratified sample of distinct texts, by doc_id."""

READ: dict[str, tuple[int, ...]] = {
    "junk": (
        256, 440, 685, 1259, 1329, 2148, 2726, 2809, 2959, 4543, 4806, 4996, 5340, 6412, 6535, 6786, 7096, 7514, 7517, 7572, 7599, 7709, 8562, 8671,
        8947, 9287, 9878,
    ),
    "table": (
        625, 985, 1288, 1530, 1552, 1795, 2141, 2684, 6072, 6199, 6649, 6669, 6904, 7331, 7745, 7752, 8159, 9351, 9710,
    ),
    "list": (
        1059, 1258, 1480, 1554, 1827, 2535, 2538, 3236, 3347, 4550, 5320, 5358, 5448, 5626, 6332, 6798, 6939, 6953, 7436, 7598, 7621, 8054, 8114,
        8470, 8742, 9360, 9727, 9900,
    ),
    "prose": (
        52, 344, 468, 581, 806, 1302, 1508, 2064, 2403, 2427, 2617, 2663, 2674, 2734, 2747, 2807, 2908, 3442, 3741, 3816, 3881, 4156, 4390, 4418,
        4514, 5024, 5258, 5451, 5465, 6200, 6281, 6316, 6372, 7028, 7165, 7268, 7300, 7395, 7396, 8048, 8301, 8447, 9011, 9110, 9594, 9687,
    ),
}

"""Published results of a finished experiment.

Fixed values: (category, price bucket, user type), control (sessions, conversions, revenue) and
treatment (sessions, conversions, gross revenue, discounts) of all segments with one dimension and of
the notable cross segments; then the group totals.
"""

SEGMENTS = [
    (("accessories", None, None), (1299, 23, 1092.77), (1309, 249, 10795.2, 2159.04)),
    (("apparel", None, None), (800, 46, 1727.85), (794, 234, 3648.75, 729.75)),
    (("appliances", None, None), (5504, 132, 9326.87), (5276, 1038, 55202.65, 10873.212)),
    (("furniture", None, None), (1629, 34, 2472.52), (1648, 291, 29138.13, 5277.156)),
    (("stationery", None, None), (1103, 79, 1864.72), (1049, 304, 2614.22, 522.844)),
    (("unknown", None, None), (412759, 13987, 519542.13), (406695, 99913, 1590323.2, 316030.384)),
    ((None, "$100-$300", None), (11447, 291, 38310.29), (11012, 1423, 225251.95, 43199.04)),
    ((None, "$25-$100", None), (48779, 2152, 137974.6), (48116, 9948, 526797.47, 105010.972)),
    ((None, "$300-$1k", None), (220, 8, 1379.15), (231, 11, 2668.19, 422.406)),
    ((None, "<$25", None), (360343, 11850, 358362.82), (356483, 90464, 937004.54, 186959.968)),
    ((None, "nan", None), (2305, 0, 0.0), (929, 183, 0.0, 0.0)),
    ((None, None, "New"), (125884, 3358, 111879.77), (125184, 36234, 589487.19, 117092.276)),
    ((None, None, "Returning"), (297210, 10943, 424147.09), (291587, 65795, 1102234.96, 218500.11)),
    (("accessories", "$300-$1k", None), None, (1, 0, 0.0, 0.0)),
    (("appliances", "$100-$300", None), (109, 13, 2160.71), (92, 21, 3001.74, 530.636)),
    (("stationery", "$25-$100", None), (25, 8, 309.2), (34, 6, 298.49, 59.698)),
    (("stationery", "<$25", None), (1075, 70, 1542.14), (1014, 298, 2315.73, 463.146)),
    (("unknown", "$100-$300", None), (10709, 271, 34946.79), (10364, 1334, 203755.57, 39519.946)),
    (("unknown", "$25-$100", None), (42733, 2020, 129372.52), (42236, 8885, 460290.49, 91807.182)),
    (("unknown", "<$25", None), (356825, 11688, 353843.67), (352951, 89502, 923608.95, 184280.85)),
]

# group: sessions, conversions, gross revenue, discounts, net revenue
GROUPS = {
    "A": (423094, 14301, 536026.86, 0.0, 536026.86),
    "B": (416771, 102029, 1691722.15, 335592.386, 1356129.764),
}

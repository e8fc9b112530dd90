"""Public keys whose private half is public, as a table for ``keys.leaked_keys``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fingerprint (first half of a SHA-256), use, where it was published, name.
LEAKED = """
42c4accd12c4f59597925e1a08a7a901 | - | Oct 2026 eMudhra CA compromise; Mozilla bug 2083449 | eMudhra EM DV TLS CA - G3B intermediate (compromised; recoverable P-384 key)
0164d7ceae5bb909c272af151ff44b11 | - | Oct 2026 eMudhra CA compromise; Mozilla bug 2083449 | eMudhra EM DV TLS CA - G3C intermediate (compromised; recoverable P-384 key)
e7568fe6e12331f4fd7de61da4c7559d | - | Oct 2026 eMudhra CA compromise; Mozilla bug 2083449 | eMudhra EM EV TLS CA - G3B intermediate (compromised; recoverable P-384 key)
432ec25f0d28de9006d97bf752f17bbb | - | Oct 2026 eMudhra CA compromise; Mozilla bug 2083449 | eMudhra EM EV TLS CA - G3C intermediate (compromised; recoverable P-384 key)
9e39de2881273acc225a149c72ba3e0f | - | Oct 2026 eMudhra CA compromise; Mozilla bug 2083449 | eMudhra EM OV CS CA - G3B intermediate (compromised; recoverable P-384 key)
4b2460a466f95fd40113bcdcca2ceb29 | - | Oct 2026 eMudhra CA compromise; Mozilla bug 2083449 | eMudhra EM OV CS CA - G3C intermediate (compromised; recoverable P-384 key)
98b896625c0c230adeec3eb2cf6aad50 | - | Oct 2026 eMudhra CA compromise; Mozilla bug 2083449 | eMudhra EM OV TLS CA - G3B intermediate (compromised; recoverable P-384 key)
cb6e15165ac802e9b3f993f16c25d41f | - | Oct 2026 eMudhra CA compromise; Mozilla bug 2083449 | eMudhra EM OV TLS CA - G3C intermediate (compromised; recoverable P-384 key)
fc92e9eb3eae184dc13dcb3bd114286f | authorized | rapid7/ssh-badkeys | array networks vapv vxag hardcoded authorized SSH key (DSA)
c210cfdf18ca0447adb5b0ee79cc6d1a | authorized | rapid7/ssh-badkeys; CVE-2014-8428 | barracuda load balancer vm hardcoded authorized SSH key (DSA)
67eab85e14b0598eead0120354f475bf | authorized | rapid7/ssh-badkeys; CVE-2015-0936 | ceragon fibeair cve 2015 0936 hardcoded authorized SSH key (RSA)
6573d8970b6166785421535f2f40c0ef | authorized | rapid7/ssh-badkeys; CVE-2015-0936 | ceragon fibeair cve 2015 0936 hardcoded authorized SSH key (RSA) [modulus]
bb2e705f21206d1086b24db7f89e9ff3 | authorized | rapid7/ssh-badkeys; CVE-2016-1561 | exagrid cve 2016 1561 hardcoded authorized SSH key (RSA)
a3e69611f431ef288db2534c0559335e | authorized | rapid7/ssh-badkeys; CVE-2016-1561 | exagrid cve 2016 1561 hardcoded authorized SSH key (RSA) [modulus]
f69acc6ea852e10b5ea05435651243a9 | authorized | rapid7/ssh-badkeys; CVE-2012-1493 | f5 bigip cve 2012 1493 hardcoded authorized SSH key (RSA)
2cdf9981c6fd23fd8568778a19da1393 | authorized | rapid7/ssh-badkeys; CVE-2012-1493 | f5 bigip cve 2012 1493 hardcoded authorized SSH key (RSA) [modulus]
3047381dfb0e94ca89dfff503139ab2a | authorized | rapid7/ssh-badkeys | loadbalancer.org enterprise va hardcoded authorized SSH key (DSA)
68fa184f69cf21f86abfa04895b082a5 | authorized | rapid7/ssh-badkeys; CVE-2013-0137 | monroe dasdec cve 2013 0137 hardcoded authorized SSH key (DSA)
56d8ea6797e269ea19de65ce622e3d2e | authorized | rapid7/ssh-badkeys | quantum dxi v1000 hardcoded authorized SSH key (DSA)
d4ce11ce13325ae152ffceae3d8fdc7b | authorized | rapid7/ssh-badkeys | vagrant default hardcoded authorized SSH key (RSA)
4fd9973c9cc206ef5f736fb578800da4 | authorized | rapid7/ssh-badkeys | vagrant default hardcoded authorized SSH key (RSA) [modulus]
b39430fcfa1c1ebbd7607971690bd223 | host | rapid7/ssh-badkeys | Actiontec q2000 rsa hardcoded SSH host key (RSA)
f5601b446df2b3f93bca85adbd6bdaac | host | rapid7/ssh-badkeys | Actiontec q2000 rsa hardcoded SSH host key (RSA) [modulus]
17d29822ca47f41872d2886fbd63c480 | host | rapid7/ssh-badkeys | Alice 1121 rsa hardcoded SSH host key (RSA)
11b777e06683f6bf5c4444c786fbaff1 | host | rapid7/ssh-badkeys | Alice 1121 rsa hardcoded SSH host key (RSA) [modulus]
952dc70ed2ca936d7949c9c14af08ca8 | host | rapid7/ssh-badkeys | Cisco RV315W dsa hardcoded SSH host key (DSA)
44f4fdf4478bed6c305afb6ece344998 | host | rapid7/ssh-badkeys | Cisco RV315W rsa hardcoded SSH host key (RSA)
f6a64465adb1392ebbe89b6f5e922956 | host | rapid7/ssh-badkeys | Cisco RV315W rsa hardcoded SSH host key (RSA) [modulus]
f177a222e30c1ba8d1158cb0b97a8966 | host | rapid7/ssh-badkeys | Cisco rtp300 dsa hardcoded SSH host key (DSA)
288d68a47ca1362f1ee9c8f5901b362b | host | rapid7/ssh-badkeys | Cisco rtp300 rsa hardcoded SSH host key (RSA)
765032a58b7d375dd65296749f8e295f | host | rapid7/ssh-badkeys | Cisco rtp300 rsa hardcoded SSH host key (RSA) [modulus]
f4e0bd73aa102858a698f213c7ef9867 | host | rapid7/ssh-badkeys | Cisco rv120w dsa hardcoded SSH host key (DSA)
2dc9787428cecf81f7efb6ac4205cd04 | host | rapid7/ssh-badkeys | Cisco rv120w rsa hardcoded SSH host key (RSA)
665eea8c2369fa9e48852b207c3cf441 | host | rapid7/ssh-badkeys | Cisco rv120w rsa hardcoded SSH host key (RSA) [modulus]
0695b8bf1c7824c7d7361e8f3daf70f3 | host | rapid7/ssh-badkeys | Comtrend AR5387UN rsa hardcoded SSH host key (RSA)
64d05455197a3691772c7c6c06ab7337 | host | rapid7/ssh-badkeys | Comtrend AR5387UN rsa hardcoded SSH host key (RSA) [modulus]
d53fedbfe92e631264629882b2e85bfd | host | rapid7/ssh-badkeys | EVW3226 rsa hardcoded SSH host key (RSA)
7ef0565b9b43866a923afbaf4f7725d2 | host | rapid7/ssh-badkeys | EVW3226 rsa hardcoded SSH host key (RSA) [modulus]
be6a57ddef3ddfd906b7fa2e7e8410a9 | host | rapid7/ssh-badkeys | Edimax AR 7167 dsa hardcoded SSH host key (DSA)
06e092220e124de1bc4184bc74a49718 | host | rapid7/ssh-badkeys | Edimax AR 7167 rsa hardcoded SSH host key (RSA)
d01d3b552888005720c172a14d624be2 | host | rapid7/ssh-badkeys | Edimax AR 7167 rsa hardcoded SSH host key (RSA) [modulus]
af493841ab8e2a596eaf5a900292a153 | host | rapid7/ssh-badkeys | Huawei bm626 dsa hardcoded SSH host key (DSA)
028831256efe633bb6fd77b621801fe9 | host | rapid7/ssh-badkeys | Huawei bm626 rsa hardcoded SSH host key (RSA)
970925b033bc2d7779adcbf37a88f94b | host | rapid7/ssh-badkeys | Huawei bm626 rsa hardcoded SSH host key (RSA) [modulus]
9bbd786283058f32c974741bbbbb111f | host | rapid7/ssh-badkeys | Innacomm w3400v rsa hardcoded SSH host key (RSA)
77f1ff8fa276a788ddbeeca403c47ee9 | host | rapid7/ssh-badkeys | Innacomm w3400v rsa hardcoded SSH host key (RSA) [modulus]
8082555767cf0600ea0aa4ebffe9bc07 | host | rapid7/ssh-badkeys | Linksys X1000 rsa hardcoded SSH host key (RSA)
d59337f69086a7da15134cf2e4776a5d | host | rapid7/ssh-badkeys | Linksys X1000 rsa hardcoded SSH host key (RSA) [modulus]
72c1447c57b7dae5285902dca356328d | host | rapid7/ssh-badkeys | Moxa 6150 rsa hardcoded SSH host key (RSA)
514520354db447f8e9e89535c0415d54 | host | rapid7/ssh-badkeys | Moxa 6150 rsa hardcoded SSH host key (RSA) [modulus]
febafd847745976ebdf5b7feca8e6811 | host | rapid7/ssh-badkeys | Moxa ia240 dsa hardcoded SSH host key (DSA)
20eefd2166894490bcfd93363dfa6cc7 | host | rapid7/ssh-badkeys | Moxa ia240 rsa hardcoded SSH host key (RSA)
d9b8bd159e3ffd70e2d4bf2e8265a524 | host | rapid7/ssh-badkeys | Moxa ia240 rsa hardcoded SSH host key (RSA) [modulus]
f8b435ae44564b7539c496f39421b2ba | host | rapid7/ssh-badkeys | Ont g4020w rsa hardcoded SSH host key (RSA)
4f537f8d449f5312721df8ab49b8745c | host | rapid7/ssh-badkeys | Ont g4020w rsa hardcoded SSH host key (RSA) [modulus]
1cbec7721880acc982240c9609825a2f | host | rapid7/ssh-badkeys | Pace V5542 dsa hardcoded SSH host key (DSA)
d110a0bdaf5f8ef3e7e9390df3d86455 | host | rapid7/ssh-badkeys | Quanta LTE hardcoded SSH host key (RSA)
30560c7163cba62ce7ffa93bd12fe60d | host | rapid7/ssh-badkeys | Quanta LTE hardcoded SSH host key (RSA) [modulus]
1dba325e7968eb634ae506274d74fcfe | host | rapid7/ssh-badkeys | Sagemcom 2740 rsa hardcoded SSH host key (RSA)
0d66cab67d514c47f45aafbba3643265 | host | rapid7/ssh-badkeys | Sagemcom 2740 rsa hardcoded SSH host key (RSA) [modulus]
875803f13d35ed7275f4d8d8df00fd56 | host | rapid7/ssh-badkeys | Sagemcom sx682 dsa hardcoded SSH host key (DSA)
4c2f4035ad4579ec3c680fa3c529345f | host | rapid7/ssh-badkeys | Seagate GoFlex dsa hardcoded SSH host key (DSA)
5ad45207c5c6e51d0b144d4abd1295ee | host | rapid7/ssh-badkeys | Seagate GoFlex rsa hardcoded SSH host key (RSA)
50e74640bfb13feb10ab39550c3823c0 | host | rapid7/ssh-badkeys | Seagate GoFlex rsa hardcoded SSH host key (RSA) [modulus]
9b3634452919bf7473e6949972e71300 | host | rapid7/ssh-badkeys | Telefonica de Espana rsa hardcoded SSH host key (RSA)
6e8a368104e8534d3b8fed3cedf9a53a | host | rapid7/ssh-badkeys | Telefonica de Espana rsa hardcoded SSH host key (RSA) [modulus]
3105dc3ffb535d624a7ebcad810c0f66 | host | rapid7/ssh-badkeys | Tplink tdw8960n V1 rsa hardcoded SSH host key (RSA)
8a1085de14298137d178e5344c61d373 | host | rapid7/ssh-badkeys | Tplink tdw8960n V1 rsa hardcoded SSH host key (RSA) [modulus]
30043301808721d9696de95ddf4a9c9e | host | rapid7/ssh-badkeys | Tplink w8950n rsa hardcoded SSH host key (RSA)
23c99871e9d8db434f62593ea9b82d9d | host | rapid7/ssh-badkeys | Tplink w8950n rsa hardcoded SSH host key (RSA) [modulus]
88460864bb18dccb47cec86810c31da2 | host | rapid7/ssh-badkeys | Tplink w8950nd rsa hardcoded SSH host key (RSA)
88fd10348bde34489329a9851f44bd4d | host | rapid7/ssh-badkeys | Tplink w8950nd rsa hardcoded SSH host key (RSA) [modulus]
2dbdf40c983c62f0a785b555870ea4fd | host | rapid7/ssh-badkeys | Trendnet tdmc500 rsa hardcoded SSH host key (RSA)
837ac6bd764654d9d8e47cde2abf7df5 | host | rapid7/ssh-badkeys | Trendnet tdmc500 rsa hardcoded SSH host key (RSA) [modulus]
2b489b05dad244ee2a0472e7b4f6fe72 | host | rapid7/ssh-badkeys | Trendnet tew715apo dsa hardcoded SSH host key (DSA)
0479d10bee56c57593163997c54abfd8 | host | rapid7/ssh-badkeys | Trendnet tew715apo rsa hardcoded SSH host key (RSA)
535655af16e5b8d5f0ecb52db0e58114 | host | rapid7/ssh-badkeys | Trendnet tew715apo rsa hardcoded SSH host key (RSA) [modulus]
8e4859eab09740c7853a2e40de761f1d | host | rapid7/ssh-badkeys | Trendnet tew816drm dsa hardcoded SSH host key (DSA)
29d928da2652f03008f1911812195624 | host | rapid7/ssh-badkeys | Trendnet tew816drm rsa hardcoded SSH host key (RSA)
479050e185e95ce58cefd616af7d204d | host | rapid7/ssh-badkeys | Trendnet tew816drm rsa hardcoded SSH host key (RSA) [modulus]
6f8ff9b84bbc2ac167d7dba3bb33b1c6 | host | rapid7/ssh-badkeys | Trendnet tvip310pi dsa hardcoded SSH host key (DSA)
913127fcca46a9b29c6d16c1ce176d87 | host | rapid7/ssh-badkeys | Trendnet tvip310pi rsa hardcoded SSH host key (RSA)
072be6b48ca59779238eabc2e1de8043 | host | rapid7/ssh-badkeys | Trendnet tvip310pi rsa hardcoded SSH host key (RSA) [modulus]
7708e1a75df7e2ea246bd0cbede8553e | host | rapid7/ssh-badkeys | Westermo MRD310 dsa hardcoded SSH host key (DSA)
00a0016b2e3abc16b66e1318654d95ff | host | rapid7/ssh-badkeys | Westermo MRD310 rsa hardcoded SSH host key (RSA)
78e905f120c2549031238e8dffea882c | host | rapid7/ssh-badkeys | Westermo MRD310 rsa hardcoded SSH host key (RSA) [modulus]
bf8f8659c1b77dfc48ef602edbd10fba | host | rapid7/ssh-badkeys | Zhone 6512a1 rsa hardcoded SSH host key (RSA)
9a5007aaf2b877a47fab91733ad6fc69 | host | rapid7/ssh-badkeys | Zhone 6512a1 rsa hardcoded SSH host key (RSA) [modulus]
cda11f4b4cf36780f219fd018d73cf90 | host | rapid7/ssh-badkeys | Zyxel fsg2200 rsa hardcoded SSH host key (RSA)
31a7bb5fb284207e87bad71419bcf96d | host | rapid7/ssh-badkeys | Zyxel fsg2200 rsa hardcoded SSH host key (RSA) [modulus]
089fd4fc5f717f89e00e08d92f6f8e3c | host | rapid7/ssh-badkeys | Zyxel p870h rsa hardcoded SSH host key (RSA)
7b992769ff10ecc500a293c9bf1db4bc | host | rapid7/ssh-badkeys | Zyxel p870h rsa hardcoded SSH host key (RSA) [modulus]
ac625884962b4caeb271e57fbf6d1f24 | host | rapid7/ssh-badkeys | Zyxel pmg1006 dsa hardcoded SSH host key (DSA)
cfbc5627427a056df35e106b75ccf43e | host | rapid7/ssh-badkeys | Zyxel pmg1006 rsa hardcoded SSH host key (RSA)
78b8850644c4bc5a843a49363b11895e | host | rapid7/ssh-badkeys | Zyxel pmg1006 rsa hardcoded SSH host key (RSA) [modulus]
5ce5a22f44a221c8479e5d54006a92c1 | host | rapid7/ssh-badkeys | Zyxel sbg3300 rsa hardcoded SSH host key (RSA)
9f910d32e6c6c3d7d7953f8934398cf8 | host | rapid7/ssh-badkeys | Zyxel sbg3300 rsa hardcoded SSH host key (RSA) [modulus]
7ca922fa8f4cc8893c5d44e19917e87a | host | rapid7/ssh-badkeys | advantech eki rsa hardcoded SSH host key (RSA)
06c22f3be974abb70d86d0ca9f534d15 | host | rapid7/ssh-badkeys | advantech eki rsa hardcoded SSH host key (RSA) [modulus]
e11109a26cbf65b19b2d571b67347f8b | host | rapid7/ssh-badkeys | kali rpi2 hardcoded SSH host key (RSA)
40b3614d0fb467ade3a4e981d992d4ad | host | rapid7/ssh-badkeys | kali rpi2 hardcoded SSH host key (RSA) [modulus]
77b06fd4eef7a6fb20efe5eeb0ea6c67 | host | rapid7/ssh-badkeys | moovbox host dsa hardcoded SSH host key (DSA)
1c22a672e957f0fae611762d9ca9f7c4 | host | rapid7/ssh-badkeys | moovbox host rsa hardcoded SSH host key (RSA)
9783fbbf41301051e3f3569484c111d5 | host | rapid7/ssh-badkeys | moovbox host rsa hardcoded SSH host key (RSA) [modulus]
c2e0b0f5ea3b04f3638efedef2a997af | host | rapid7/ssh-badkeys; CVE-2009-4510 | tandberg vcs hardcoded SSH host key (DSA)
68a64cc62e75797518c09457274d49cb | host | rapid7/ssh-badkeys | zyxel q100 rsa hardcoded SSH host key (RSA)
d54618220edfc4a028548163f5bbb7dc | host | rapid7/ssh-badkeys | zyxel q100 rsa hardcoded SSH host key (RSA) [modulus]
1a1d1e22ed40ca6ff2aa31583ab9d305 | host | rapid7/ssh-badkeys | zyxel vmg1312 rsa hardcoded SSH host key (RSA)
74116e1e606879b6f79c611b572fce03 | host | rapid7/ssh-badkeys | zyxel vmg1312 rsa hardcoded SSH host key (RSA) [modulus]
"""


def leaked_corpus(spark: SparkSession) -> DataFrame:
    """``(fingerprint, name, key_use, ref)`` of the fixed keys above."""
    rows = [[f.strip() for f in line.split(" | ")] for line in LEAKED.strip().splitlines()]
    return spark.createDataFrame([(fp, name, "" if use == "-" else use, ref) for fp, use, ref, name in rows], "fingerprint string, name string, key_use string, ref string")

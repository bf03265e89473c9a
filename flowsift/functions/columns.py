"""Scalar column functions: flow keys and ids, ports, addresses, times, safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TCP, UDP = 6, 17
#: TCP flag bits.
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32
#: Assigned IP protocol numbers by name, and other names that labelled flows use for them.
#: Labelled flows also name ip, any, isis, sccopmce, pri-enc, zero, ib, arp, udt and rtp; for them these stand for no number, so that such flows match no packet.
PROTOCOLS = {name: int(number) for number, *names in (line.split() for line in """
0 hopopt
1 icmp
2 igmp
3 ggp
4 ipv4 ipencap ipnip
5 st st2
6 tcp
7 cbt
8 egp
9 igp
10 bbn-rcc
11 nvp
12 pup
13 argus
14 emcon
15 xnet
16 chaos
17 udp
18 mux
19 dcn
20 hmp
21 prm
22 xns-idp
23 trunk-1
24 trunk-2
25 leaf-1
26 leaf-2
27 rdp
28 irtp
29 iso-tp4
30 netblt
31 mfe-nsp
32 merit-inp
33 dccp sep
34 3pc
35 idpr
36 xtp
37 ddp
38 idpr-cmtp
39 tp++
40 il
41 ipv6
42 sdrp
43 ipv6-route
44 ipv6-frag
45 idrp
46 rsvp
47 gre
48 dsr mhrp
49 bna
50 esp
51 ah
52 i-nlsp
53 swipe
54 narp
55 mobile
56 tlsp
57 skip
58 ipv6-icmp icmp6
59 ipv6-no ipv6-nonxt
60 ipv6-opts
62 cftp
64 sat-expak
65 kryptolan
66 rvd
67 ippc
69 sat-mon
70 visa
71 ipcv
72 cpnx
73 cphb rspf
74 wsn
75 pvp
76 br-sat-mon
77 sun-nd
78 wb-mon
79 wb-expak
80 iso-ip
81 vmtp
82 secure-vmtp
83 vines
84 ttp iptm
85 nsfnet-igp
86 dgp
87 tcf
88 eigrp
89 ospf ospfigp
90 sprite-rpc
91 larp
92 mtp
93 ax.25
94 ipip
95 micp
96 scc-sp aes-sp3-d
97 etherip
98 encap
100 gmtp
101 ifmp
102 pnni
103 pim
104 aris
105 scps
106 qnx
107 a/n
108 ipcomp
109 snp
110 compaq-peer
111 ipx-n-ip
112 vrrp
113 pgm
115 l2tp
116 ddx
117 iatp
118 stp
119 srp
120 uti
121 smp
122 sm
123 ptp
125 fire
126 crtp
127 crudp
128 sscopmce
129 iplt
130 sps
131 pipe
132 sctp
133 fc
134 rsvp-e2e-ignore
135 mobility-header
136 udplite
137 mpls-in-ip
138 manet
139 hip
140 shim6
141 wesp
142 rohc
143 ethernet
144 unas
255 reserved
""".strip().splitlines()) for name in names}


def safe_div(num: Column, den: Column) -> Column:
    """num / den in doubles; a zero denominator gives infinity."""
    return F.when(den == 0, F.lit(float("inf"))).otherwise(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)))


def flow_key(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column, protocol: Column) -> Column:
    """Direction-free key with the smaller address first; with equal addresses the direction stays in the key."""
    forward = src_ip < dst_ip
    pick = lambda a, b: F.when(forward, a).otherwise(b)
    return F.struct(pick(src_ip, dst_ip).alias("ip_a"), pick(dst_ip, src_ip).alias("ip_b"), pick(src_port, dst_port).alias("port_a"), pick(dst_port, src_port).alias("port_b"), protocol.alias("protocol"))


def flow_id(src: Column, dst: Column, sport: Column, dport: Column, proto: Column) -> Column:
    return F.concat_ws("-", src.cast("string"), dst.cast("string"), sport.cast("string"), dport.cast("string"), proto.cast("string"))


def reverse_flow_id(text: Column) -> Column:
    """Both halves of a five-part id exchanged; any other text is an invalid flow."""
    p = F.split(text, "-")
    return F.when(F.size(p) != 5, F.lit("<invalid flow>")).otherwise(F.concat_ws("-", p[1], p[0], p[3], p[2], p[4]))


def port_or_zero(port: Column) -> Column:
    return F.coalesce(port, F.lit(0))


def port_digits(port: Column, prefix: str, digits: int = 8) -> list[Column]:
    """Decimal digits, the least significant first."""
    return [F.pmod(F.floor(port / F.lit(10**n)), F.lit(10)).cast("int").alias(f"{prefix}_digit_{n}") for n in range(digits)]


def ip_octets(ip: Column, prefix: str) -> list[Column]:
    """Sixteen places, highest first: -1 but for the four octets of an IPv4 number; all -1 below 65536."""
    out = []
    for place in range(16, 0, -1):
        octet = F.shiftright(ip, 8 * (place - 1)).bitwiseAND(F.lit(255)).cast("int") if place <= 4 else F.lit(-1)
        out.append(F.when(ip < 65536, F.lit(-1)).otherwise(octet).alias(f"{prefix}_dotted_{place}"))
    return out


def protocol_number(name: Column) -> Column:
    """Number of a protocol name, null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in PROTOCOLS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(name)))


def unassigned_protocol(number: Column) -> Column:
    """144 to 252 are one unassigned number."""
    return F.when(number.between(144, 252), F.lit(144)).otherwise(number)


def flag_set(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)


def cic_timestamp(text: Column, zone: str = "Canada/Atlantic", business_hours: bool = False) -> Column:
    """d/M/yyyy h:mm[:ss] local time to UTC; business_hours takes hours 1 to 7 as afternoon."""
    t = F.coalesce(F.try_to_timestamp(text, F.lit("d/M/yyyy H:mm:ss")), F.try_to_timestamp(text, F.lit("d/M/yyyy H:mm")))
    if business_hours:
        t = F.when(F.hour(t).between(1, 7), t + F.expr("INTERVAL 12 HOURS")).otherwise(t)
    return F.to_utc_timestamp(t, zone)


def traffic_type(label: Column) -> Column:
    """0 benign, 1 attack."""
    return F.when(label == 0, F.lit(0)).otherwise(F.lit(1))


def normal_info(info: Column) -> Column:
    return F.lower(F.trim(F.coalesce(info, F.lit(""))))


def whole_seconds(seconds: Column, mode: str) -> Column:
    """Seconds as they are (none), rounded up (ceil) or to the nearest whole, halves to the even one (round)."""
    if mode not in ("none", "ceil", "round"):
        raise ValueError(f"unknown mode {mode}")
    return seconds if mode == "none" else (F.ceil(seconds) if mode == "ceil" else F.bround(seconds, 0)).cast("double")


def percent_text(share: Column) -> Column:
    """A share in percent with three places."""
    return F.format_string("%3.3f%%", share * 100)


def shortened(text: Column, most: int = 10) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(".."))).otherwise(text)

"""Template generators: cross products of small vocabularies.

A line of SPEC is one part of a generator: id | intent | group | domain | context (T, F or -) |
pools | shape | turns | rewrite | limit.  Pools are name=poolN, the first N values of a pool;
"a<b" or "a<>b" in the place of a pool pairs one pool with itself, and "a!=b" drops equal
values.  Turns are separated by " / ".  {name} is the value of a pool in this row,
{*pool} one of a pool by hash and {*pool!name} one that is not the value of name, which is of that pool.
Intents, groups and domains are fixed values.  A limit keeps that many rows in hash order.

The vocabulary is the engine's own.  ``corpus`` makes the samples; ``corpus_sql`` says the same
as SQL with a cross join for each part, for comparison in another engine.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hashed
from ..operators.dialogue import render

POOLS = {
    "on": "bật điều hòa|mở điều hòa|khởi động máy lạnh|cho máy lạnh chạy|mở máy lạnh|bật hệ thống làm mát",
    "off": "tắt điều hòa|ngắt máy lạnh|đóng máy lạnh",
    "temp": "17|18|19|21|22|23|24|25|26|28",
    "mode": "gió nhẹ|làm khô|tự động|ban đêm|mạnh",
    "zone": "ghế trước|ghế sau|bên trái|bên phải|toàn xe",
    "fan": "1|2|3|4|5",
    "play": "bật nhạc|mở nhạc|phát bài|chơi nhạc",
    "pause": "dừng nhạc|tạm ngưng nhạc|ngắt nhạc",
    "song": "Mùa Xuân Đầu Tiên|Diễm Xưa|Hạ Trắng|Biển Nhớ|Phố Xa|Quê Hương|Bèo Dạt Mây Trôi|Trống Cơm|Lý Cây Bông",
    "artist": "Khánh Ly|Thanh Tuyền|Quang Dũng|Hồng Nhung|Bằng Kiều|Trần Thu Hà",
    "playlist": "nhạc buổi sáng|nhạc cổ điển|nhạc không lời|nhạc đồng quê|nhạc thiếu nhi|nhạc phim",
    "radio": "kênh tin tức|kênh giao thông|kênh thể thao|kênh ca nhạc",
    "volume": "5|15|25|35|45|55|65|75",
    "nav": "chỉ đường tới|đi tới|dẫn đường đến|tìm đường đến",
    "place": "chợ Bến Thành|ga Sài Gòn|cầu Long Biên|chùa Một Cột|bảo tàng Dân tộc|công viên Thống Nhất|nhà hát Lớn|hồ Tây|sân vận động Mỹ Đình|bến xe Miền Đông",
    "poi": "cây xăng|tiệm thuốc|quán phở|khách sạn|bãi xe|ngân hàng|tiệm sách",
    "pref": "tránh phà|tránh đường đất|đường ít đèn đỏ|đường ven sông|đường ngắn",
    "dist": "900 mét|2 cây số|3 cây số|5 cây số|6 cây số|8 cây số",
    "contact": "bà ngoại|anh Hùng|chị Thảo|cô Vân|anh Sơn|chú Ba|bạn Linh|thầy Quân|anh Phúc",
    "called": "anh Hùng|anh Sơn|anh Phúc|bà ngoại|chú Ba",
    "sms": "con sắp tới nơi|đường đang ngập|chiều họp nhé|nhớ mua sữa|chờ thêm một lát",
    "call": "gọi|gọi giúp|bấm số|liên hệ",
    "window": "kính trước trái|kính trước phải|kính sau trái|kính sau phải|cửa sổ trời",
    "seat": "ghế tài|ghế khách|ghế sau trái|ghế sau phải",
    "heat": "1|2|3",
    "battery": "6|9|14|18|22",
    "range": "25|45|65|95",
    "network": "trạm A|trạm B|trạm C",
    "drive": "êm ái|mạnh mẽ|đường trơn|đường núi|tiết kiệm|bình thường",
    "speed": "55|65|75|85|95|105",
    "outdoor": "31|33|35|37",
    "step": "1|2|3",
    "way": "tăng|giảm",
    "yes": "đúng|ừ|phải đó|chuẩn|được",
    "no": "thôi|đừng làm nữa|hủy đi|bỏ qua đi|không cần",
    "ref": "bài đó|bài vừa rồi|bản ấy|bài của người ấy|cái này|bài kia",
    "there": "tới đó đi|đi chỗ đó|đưa tôi tới đấy|chỗ ấy nhé|đi nơi đó|tới nơi ấy",
    "time": "bảy giờ|chín giờ|mười giờ",
    "event": "họp lớp|khám răng|xem phim|đón con",
    "device": "đèn bếp|rèm phòng ngủ|máy lọc nước|cổng|đèn sân",
    "ask_temp": "Bạn muốn bao nhiêu độ?|Đặt mấy độ ạ?|Mức nhiệt nào ạ?",
    "open": "Tôi muốn đi đến|Hãy dẫn đường đến|Chỉ đường tới|Đưa tôi đến",
    "context": "trời hôm nay đẹp|mấy giờ rồi|kể chuyện vui đi|thời tiết thế nào|tin mới có gì|đội nhà thắng chưa|hôm nay thứ mấy|bạn tên gì|xe chạy êm nhỉ",
}
SPEC = """
T01|set_ac_temperature|complete_utterance|ac|-|v=on6 t=temp9|u|{v} mức {t} độ|Đặt điều hòa ở {t} độ.
T01|turn_off_ac|complete_utterance|ac|-|v=off3|u|{v}|Tắt điều hòa.
T02|play_music|complete_utterance|music|-|v=play4 s=song4|u|{v} {s}|Phát bài {s}.
T02|pause_music|complete_utterance|music|-|v=pause3|u|{v}|Tạm dừng nhạc.
T03|navigate_to_location|complete_utterance|navigation|-|v=nav4 p=place6|u|{v} {p}|{*open} {p}.
T04|call_contact|complete_utterance|calling|-|v=call4 c=contact7|u|{v} {c}|Gọi cho {c}.
T05|set_ac_temperature|missing_intent|ac|-|v=on6 t=temp9|ubu|{v} / {*ask_temp} / {t} độ|Đặt điều hòa ở {t} độ.
T06|call_contact|missing_intent|calling|-|c=contact7|ubu|gọi điện / Bạn muốn gọi ai? / {c}|Gọi cho {c}.
T07|play_music|missing_intent|music|-|s=song4|ubu|mở nhạc / Bạn muốn nghe bài nào? / {s}|Phát bài {s}.
T08|navigate_to_location|pronoun_resolution|navigation|-|p=place6 v=there4 k=heat3|ubu|{p} cách đây bao xa / {p} cách {k} cây số / {v}|{*open} {p}.
T09|play_music|pronoun_resolution|music|-|s=song4 r=ref4|ubu|{s} là bài của ai / Bài của {*artist} / mở {r}|Phát bài {s}.
T10|call_contact|confirmation|calling|-|c=contact7 y=yes5|ubu|gọi {c} / Gọi {c} phải không? / {y}|Gọi cho {c}.
T11|cancel_action|cancellation|ac|-|t=temp9 n=no4|ubu|đặt {t} độ / Đang đặt {t} độ / {n}|Hủy đặt điều hòa ở {t} độ.
T12|decrease_temperature|parameter_adjustment|ac|-|t=temp9 k=step3|ubu|đặt {t} độ / Đã đặt {t} độ / giảm thêm {k} độ|Giảm điều hòa {k} độ.
T12|increase_temperature|parameter_adjustment|ac|-|t=temp9 k=step3|ubu|đặt {t} độ / Đã đặt {t} độ / tăng thêm {k} độ|Tăng điều hòa {k} độ.
T13|set_ac_temperature|irrelevant_context|ac|-|o=outdoor4 t=temp9 o!=t|ubu|ngoài trời mấy độ / Ngoài trời {o} độ / đặt điều hòa {t} độ|Đặt điều hòa ở {t} độ.
T14|set_ac_temperature|slot_filling|climate|T|v=on5 t=temp10|ubu|{v} / {*ask_temp} / {t} độ|Đặt điều hòa ở {t} độ.
T15|set_ac_temperature_with_mode|slot_filling|climate|T|t=temp6 m=mode5|ubu|đặt {t} độ / Chế độ nào ạ? / {m}|Đặt điều hòa ở {t} độ, chế độ {m}.
T16|set_fan_level_zone|slot_filling|climate|T|f=fan5 z=zone5|ubu|quạt mức {f} / Cho khu vực nào? / {z}|Đặt quạt mức {f} cho {z}.
T17|call_contact|slot_filling|calling|T|c=contact9|ubu|{*call} cho người quen / Bạn muốn gọi ai? / {c}|Gọi cho {c}.
T18|send_sms|slot_filling|messaging|T|c=contact9 s=sms5|ubu|nhắn tin cho {c} / Nội dung là gì? / {s}|Nhắn cho {c}: {s}.
T19|play_music|slot_filling|music|T|v=play3 s=song9|ubu|{v} / Bài nào ạ? / {s}|Phát bài {s}.
T20|play_playlist|slot_filling|music|T|l=playlist6|ubu|mở danh sách nhạc / Danh sách nào? / {l}|Phát danh sách {l}.
T21|navigate_to_location|slot_filling|navigation|T|p=place10|ubu|chỉ đường giúp tôi / Bạn muốn đi đâu? / {p}|{*open} {p}.
T22|open_window|slot_filling|vehicle|T|w=window5|ubu|mở cửa sổ / Cửa nào ạ? / {w}|Mở {w}.
T23|set_seat_heat|slot_filling|vehicle|T|s=seat4 k=heat3|ubu|sưởi {s} / Mức mấy ạ? / mức {k}|Bật sưởi {s} mức {k}.
T24|set_cruise_control|slot_filling|driver_assist|T|k=speed6|ubu|bật ga tự động / Tốc độ bao nhiêu? / {k}|Đặt ga tự động {k} km/h.
T25|call_contact|confirmation|calling|T|c=contact9 y=yes5|ubu|gọi {c} / Gọi {c} phải không? / {y}|Gọi cho {c}.
T26|cancel_call|cancellation|calling|T|c=contact9 n=no5|ubu|gọi {c} / Đang gọi {c} / {n}|Hủy cuộc gọi cho {c}.
T27|adjust_ac_temperature|adjustment|climate|T|t=temp6 k=step3 w=way2|ubu|đặt {t} độ / Đã đặt {t} độ / {w} {k} độ nữa|Điều chỉnh điều hòa: {w} {k} độ.
T28|adjust_volume|adjustment|music|T|k=step3 w=way2|ubu|mở nhạc / Đang phát {*song} / {w} tiếng {k} nấc|Âm lượng {w} {k} nấc.
T29|navigate_to_location|reference_resolution|navigation|T|p=place10 v=there6|ubu|{p} ở đâu / {p} cách {*dist} / {v}|{*open} {p}.
T30|play_music|reference_resolution|music|T|s=song9 r=ref6|ubu|bài {s} hay không / Bài {s} do {*artist} hát / mở {r}|Phát bài {s}.
T31|call_contact|reference_resolution|calling|T|c=contact9|ubu|số của {c} là gì / Đã tìm thấy số của {c} / {*call} người đó|Gọi cho {c}.
T32|navigate_to_location|disambiguation|navigation|T|a=place10 b=place10 a<b|ubu|tìm chỗ chơi / Có {a} và {b}, bạn chọn nơi nào? / chỗ thứ hai|{*open} {b}.|30
T33|chained_climate_music|chained_intent|multi|F|m=mode3 s=song4|ubu|chào bạn / Chào bạn / để gió chế độ {m} và phát bài {s}|Đặt điều hòa chế độ {m} và phát bài {s}.
T34|set_ac_temperature|irrelevant_context|climate|F|o=outdoor3 t=temp10 o!=t|ubu|ngoài kia nóng không / Ngoài trời {o} độ / đặt điều hòa {t} độ|Đặt điều hòa ở {t} độ.
T35|find_charging_station|slot_filling|navigation|T|k=battery5 n=network3|bubu|Pin còn {k} phần trăm / tìm chỗ sạc / Bạn muốn hãng nào? / {n}|Tìm trạm sạc {n} gần đây.
T36|navigate_with_preference|multi_slot|navigation|T|p=place10 f=pref5|ububu|chỉ đường / Bạn muốn đi đâu? / {p} / Bạn muốn đi thế nào? / {f}|{*open} {p}, ưu tiên {f}.
T37|send_sms|multi_slot|messaging|T|c=contact9 s=sms5|ububu|nhắn tin / Cho ai ạ? / {c} / Nội dung? / {s}|Nhắn cho {c}: {s}.
T38|set_ac_temperature_with_mode|multi_slot|climate|T|t=temp4 m=mode5|ububu|bật điều hòa / Mấy độ ạ? / {t} / Chế độ nào? / {m}|Đặt điều hòa ở {t} độ, chế độ {m}.
T39|call_contact_speaker|multi_slot|calling|T|c=contact9|ububu|gọi điện / Gọi ai ạ? / {c} / Dùng loa ngoài không? / có|Gọi cho {c} bằng loa ngoài.
T40|play_music|correction|music|T|a=song9 b=song9 a<>b|ububu|mở nhạc / Bài nào ạ? / {a} / Đang phát {a} / à không, {b}|Phát bài {b}.|60
T41|navigate_to_location|correction|navigation|T|a=place10 b=place10 a<>b|ububu|chỉ đường / Đi đâu ạ? / {a} / Đang đi {a} / nhầm rồi, {b}|{*open} {b}.|40
T42|navigate_to_location|comparison|navigation|T|k=poi7|ububu|tìm {k} / Có ba nơi: {*place}, cách {*dist} / nơi nào gần nhất / Nơi đầu tiên / đi chỗ đó|{*open} {k} gần nhất.
T43|find_charging_station|conditional|navigation|T|k=battery5 r=range4|ububu|pin còn bao nhiêu / Còn {k} phần trăm, đi được {r} km / nếu không đủ thì sạc / Quãng đường dài hơn {r} km / vậy tìm trạm đi|Tìm trạm sạc trong {r} km.
T44|call_contact|disambiguation|calling|T|c=called5|ububu|gọi người nhà / Có nhiều người / người hay gọi ấy / Là {c}? / {*yes}|Gọi cho {c}.
T45|open_window|no_repeat_action|vehicle|T|v=on3 w=window5|ububu|{v} / Đã bật điều hòa / cảm ơn / Không có gì / mở {w} nữa|Mở {w}.
T46|play_radio_volume|multi_slot|music|T|r=radio4 k=volume8|ububu|bật đài / Kênh nào? / {r} / Âm lượng bao nhiêu? / {k}|Bật {r} với âm lượng {k}.
T47|smart_home_combo|chained_intent|smart_home|T|d=device3|ububu|sắp về nhà / Bạn cần gì? / mở {d} / Đã mở {d} / {*device} nữa|Mở thêm thiết bị sau {d}.
T48|navigate_with_preference|multi_slot|navigation|T|p=place4 f=pref5 t=time3|ubububu|chỉ đường / Đi đâu ạ? / {p} / Đi thế nào? / {f} / Mấy giờ đi? / {t}|{*open} {p}, ưu tiên {f} và khởi hành {t}.
T49|send_sms|multi_slot|messaging|T|c=contact9 s=sms5|ubububu|nhắn tin / Cho ai? / {c} / Nội dung? / {s} / Gửi nhé? / {*yes}|Nhắn cho {c}: {s}.
T50|set_ac_full|multi_slot|climate|T|t=temp4 m=mode3 z=zone3|ubububu|bật điều hòa / Mấy độ? / {t} / Chế độ? / {m} / Khu vực? / {z}|Đặt điều hòa {t} độ, chế độ {m}, cho {z}.|60
T51|play_playlist_source_volume|multi_slot|music|T|l=playlist3 k=volume4|ubububu|mở nhạc / Danh sách nào? / {l} / Nguồn nào? / trên xe / Âm lượng? / {k}|Phát danh sách {l} trên xe, âm lượng {k}.
T52|find_charging_station|multi_slot|navigation|T|k=battery3 n=network3 w=way2|bubububu|Pin còn {k} phần trăm / tìm trạm / Hãng nào? / {n} / Muốn {w} tốc độ sạc không? / có / Khi nào đi? / {*time}|Tìm trạm sạc {n}.
T53|chained_nav_music_call|correction|multi|T|a=place4 b=song3 c=contact3|ububu|đi {a} và mở bài {b} / Đang đi {a}, đang phát {b} / đổi sang bài {*song!b} / Đã đổi sang {*song!b} / rồi gọi {c}|Đi tới {a}, phát bài {*song!b} và gọi {c}.|40
T54|navigate_scheduled|multi_slot|navigation|T|e=event4 t=time3|ububu|hôm nay có lịch gì / {e} lúc {t} / ở đâu / Tại {*place} / đi tới đó|Dẫn đường tới nơi {e} lúc {t}.
T55|drive_mode_full|multi_slot|driver_assist|T|k=heat3 d=drive6|ububu|đổi kiểu lái / Kiểu nào? / {d} / Mức mấy? / {k}|Đặt kiểu lái {d} mức {k}.
T56|set_ac_temperature_with_mode|irrelevant_context|climate|F|t=temp3 m=mode3|ububu|kể chuyện đi / Chuyện gì ạ? / thôi khỏi / Vâng / đặt điều hòa {t} độ chế độ {m}|Đặt điều hòa ở {t} độ, chế độ {m}.
T57|defrost_with_settings|multi_slot|climate|T|k=heat3 f=fan3|ubububu|kính mờ quá / Bật sấy kính nhé? / ừ / Mức mấy? / {k} / Quạt mức mấy? / {f}|Bật sấy kính mức {k}, quạt mức {f}.
T58|set_ac_temperature|no_context_needed|climate|F|t=temp10 c=context9|ubu|{c} / Vâng / đặt điều hòa {t} độ|Đặt điều hòa ở {t} độ.
T58|turn_off_ac|no_context_needed|climate|F|t=off1 c=context9|ubu|{c} / Vâng / {t}|Tắt điều hòa.
T58|play_music|no_context_needed|music|F|t=song9 c=context9|ubu|{c} / Vâng / phát bài {t}|Phát bài {t}.
T58|call_contact|no_context_needed|calling|F|t=contact9 c=context9|ubu|{c} / Vâng / gọi {t}|Gọi cho {t}.
T58|navigate_to_location|no_context_needed|navigation|F|t=place10 c=context9|ubu|{c} / Vâng / đi tới {t}|{*open} {t}.
T58|set_volume|no_context_needed|music|F|t=volume8 c=context9|ubu|{c} / Vâng / âm lượng {t}|Đặt âm lượng {t}.
T58|open_window|no_context_needed|vehicle|F|t=window5 c=context9|ubu|{c} / Vâng / mở {t}|Mở {t}.
T58|smart_home|no_context_needed|smart_home|F|t=device5 c=context9|ubu|{c} / Vâng / bật {t} ở nhà|Bật {t}.
T58|set_fan|no_context_needed|climate|F|t=fan5 c=context9|ubu|{c} / Vâng / quạt mức {t}|Đặt quạt mức {t}.
T59|play_music|no_repeat_action|music|T|v=on4 s=song4|ubu|{v} / Đã bật điều hòa / giờ thì mở {s}|Phát bài {s}.
T59|call_contact|no_repeat_action|calling|T|v=on4 c=contact3|ubu|{v} / Đã bật điều hòa / giờ thì gọi {c}|Gọi cho {c}.
T60|set_volume|no_repeat_action|music|T|s=song5 k=volume3|ubu|phát bài {s} / Đang phát {s} / to lên mức {k}|Đặt âm lượng {k}.
T61|play_playlist|no_repeat_action|music|T|p=place6 l=playlist3|ubu|đi tới {p} / Đang dẫn đường đến {p} / mở thêm {l}|Phát danh sách {l}.
"""
SINGLE = tuple(f"T{i:02d}" for i in range(1, 14))


def hash_sql(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def _text(template: str, row: str) -> str:
    out = []
    for piece in re.split(r"(\{[^}]*\})", template):
        if piece.startswith("{*"):
            name, _, other = piece[2:-1].partition("!")
            pool = POOLS[name].split("|")
            at = f"({hash_sql(f"'{piece[2:-1]}|' || {row}")} % {len(pool) - bool(other)})"
            at = f"({at} + CASE WHEN {at} >= {other}_i THEN 1 ELSE 0 END)" if other else at
            out.append(f"CASE {at} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(pool)) + " END")
        elif piece.startswith("{"):
            out.append(piece[1:-1])
        elif piece:
            out.append(f"'{piece}'")
    return " || ".join(out)


def part_sql(line: str, part: int) -> str:
    name, intent, group, domain, ctx, pools, shape, turns, rewrite, *limit = line.split("|")
    sources, places, where = [], [], []
    for p in pools.split():
        if "=" in p and "!=" not in p:
            alias, pool = p.split("=")
            kind, n = re.fullmatch(r"([a-z_]+)(\d+)", pool).groups()
            values = ", ".join(f"({i}, '{v}')" for i, v in enumerate(POOLS[kind].split("|")[: int(n)]))
            sources.append(f"(VALUES {values}) AS pool_{alias}({alias}_i, {alias})")
            places.append((f"{alias}_i", int(n)))
        else:
            a, op, b = re.fullmatch(r"(\w+)(<>|<|!=)(\w+)", p).groups()
            where.append(f"{a} <> {b}" if op == "!=" else f"{a}_i {op} {b}_i")
    at = "0"
    for place, n in places:
        at = f"({at} * {n} + {place})"
    row = f"'{name}-{part}-' || cast({at} as varchar(20))"
    texts = [_text(t, row) for t in turns.split(" / ")]
    roles = ["user" if c == "u" else "bot" for c in shape]
    blob = " || ".join((f"'{chr(10) if i else ''}{r}: ' || {t}") for i, (r, t) in enumerate(zip(roles, texts)))
    select = (
        f"SELECT '{name}' AS gen_id, {part} AS part, cast({at} as bigint) AS ord, '{intent}' AS intent, '{group}' AS grp, '{domain}' AS domain, "
        f"cast({ {'T': 'true', 'F': 'false', '-': 'null'}[ctx]} as boolean) AS context_required, {shape.count('u')} AS user_turns, {len(shape)} AS n_turns, "
        f"{blob} AS blob, {texts[-1]} AS last_user, {_text(rewrite, row)} AS rewrite, {row} AS sample_id FROM {' CROSS JOIN '.join(sources)}"
    )
    select += f" WHERE {' AND '.join(where)}" if where else ""
    if limit:
        select = f"SELECT * FROM ({select}) AS all_{part} ORDER BY {hash_sql("'limit|' || sample_id")}, sample_id LIMIT {limit[0]}"
        select = f"SELECT * FROM ({select}) AS some_{part}"
    return select


def _lines(only: tuple[str, ...] | None) -> list[str]:
    lines = SPEC.strip().split("\n")
    if unknown := set(only or ()) - {x[:3] for x in lines}:
        raise ValueError(f"no generators {sorted(unknown)}")
    return [x for x in lines if only is None or x[:3] in only]


@lru_cache(maxsize=None)
def corpus_sql(only: tuple[str, ...] | None = None) -> str:
    """All samples of the generators named (of all generators); ValueError for a name that is not known."""
    lines = _lines(only)
    return " UNION ALL ".join(f"({part_sql(x, i)})" for i, x in enumerate(lines))


def _parts(only: tuple[str, ...] | None) -> list[tuple]:
    out = []
    for part, line in enumerate(_lines(only)):
        name, intent, group, domain, ctx, pools, shape, turns, rewrite, *limit = line.split("|")
        names, values, rule = [], [], None
        for p in pools.split():
            if "=" in p and "!=" not in p:
                alias, pool = p.split("=")
                kind, n = re.fullmatch(r"([a-z_]+)(\d+)", pool).groups()
                names.append(alias)
                values.append(POOLS[kind].split("|")[: int(n)])
            else:
                a, op, b = re.fullmatch(r"(\w+)(<>|<|!=)(\w+)", p).groups()
                rule = (names.index(a), op, names.index(b))
        steps = [1] * len(names)
        for k in reversed(range(len(names) - 1)):
            steps[k] = steps[k + 1] * len(values[k + 1])
        picks = []
        for x in dict.fromkeys(re.findall(r"\{\*([\w!]+)\}", turns + rewrite)):
            pool, _, other = x.partition("!")
            picks.append((x, POOLS[pool].split("|"), names.index(other) if other else None))
        flag = {"T": True, "F": False, "-": None}[ctx]
        roles = ["user" if c == "u" else "bot" for c in shape]
        out.append((name, part, intent, group, domain, flag, roles, turns.split(" / "), rewrite, names, values, steps, rule, picks, int(limit[0]) if limit else None))
    return out


def corpus(spark: SparkSession, only: tuple[str, ...] | None = None) -> DataFrame:
    """All samples of the generators named (of all), with their turns: one plan for all generators.
    A part's combinations are numbered; a number's digits, to the bases of the pools' sizes, are
    the places of its values in the pools."""
    schema = (
        "gen_id string, part int, intent string, grp string, domain string, context_required boolean, roles array<string>, texts array<string>, rewrite string, "
        "names array<string>, pools array<array<string>>, steps array<int>, rule struct<a:int,op:string,b:int>, picks array<struct<name:string,pool:array<string>,other:int>>, most int"
    )
    df = spark.createDataFrame(_parts(only), schema).coalesce(1)
    df = df.withColumn("ord", F.explode(F.expr("sequence(0L, steps[0] * size(pools[0]) - 1L)")))
    df = df.withColumn("at", F.expr("transform(pools, (p, k) -> int((ord div steps[k]) % size(p)))"))
    df = df.withColumn("own", F.expr("transform(names, (n, k) -> struct(n as name, pools[k][at[k]] as value))"))
    df = df.filter(F.expr("rule is null or case rule.op when '<' then at[rule.a] < at[rule.b] when '<>' then at[rule.a] <> at[rule.b] else own[rule.a].value <> own[rule.b].value end"))
    df = df.withColumn("sample_id", F.concat_ws("-", "gen_id", "part", "ord"))
    place = lambda p: (hashed(F.concat(p["name"], F.lit("|"), F.col("sample_id")), None) % (F.size(p["pool"]) - p["other"].isNotNull().cast("int"))).cast("int")
    past = lambda p: F.coalesce((place(p) >= F.get("at", p["other"])).cast("int"), F.lit(0))
    df = df.withColumn("picked", F.transform("picks", lambda p: F.struct(F.concat(F.lit("*"), p["name"]).alias("name"), F.get(p["pool"], place(p) + past(p)).alias("value"))))
    df = df.withColumn("with", F.concat("own", "picked"))
    filled = lambda t: F.aggregate("with", t, lambda x, v: F.replace(x, F.concat(F.lit("{"), v["name"], F.lit("}")), v["value"]))
    df = df.withColumns({"turns": F.zip_with("roles", F.transform("texts", filled), lambda r, t: F.struct(r.alias("role"), t.alias("content"))), "rewrite": filled(F.col("rewrite"))})
    rank = F.row_number().over(Window.partitionBy("part").orderBy(hashed(F.col("sample_id"), "limit"), "sample_id"))
    few = df.filter("most is not null").withColumn("rn", rank).filter("rn <= most").drop("rn")
    df = df.filter("most is null").unionByName(few)
    users = F.filter("turns", lambda t: t["role"] == "user")
    return df.select(
        "gen_id", "part", "ord", "intent", "grp", "domain", "context_required", F.size(users).alias("user_turns"), F.size("turns").alias("n_turns"), render(F.col("turns")).alias("blob"),
        F.element_at(users, -1)["content"].alias("last_user"), "rewrite", "sample_id", "turns",
    )

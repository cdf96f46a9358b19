"""Made-up pages of the three portals, as they would be landed."""

import json
from datetime import datetime, timezone

from offerwatch import config as C

AT = datetime(2024, 5, 1, 8, 0, 0, tzinfo=timezone.utc)


def embed(state):
    return f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps(state, ensure_ascii=False)}</script></html>'


def queries(key, data, status="success", extra=()):
    found = [*extra, {"queryKey": [key, {"x": 1}], "state": {"status": status, "data": data}}]
    return embed({"props": {"pageProps": {"dehydratedState": {"queries": found}}}})


def page(source, kind, body, tx=None, page_no=1, key=None, status=200, run_id="r1", run_seq=1, url=None, at=AT):
    return (run_id, run_seq, source, kind, tx, page_no, url, key, status, at, body)


def result(id, name="Byt 2+kk 55 m²", price=20000, code=4, label="2+kk", street="Dlouhá", lat=50.1, lon=14.5, images=("//img/a.jpg",), per=None):
    return {
        "id": id, "name": name, "priceCzk": price, "priceCzkPerSqM": per,
        "categorySubCb": {"value": code, "name": label},
        "locality": {"street": street, "cityPart": "Vysočany", "city": "Praha", "latitude": lat, "longitude": lon},
        "images": [{"url": u} for u in images],
    }


def search(results, tx="pronajem", total=None, offset=0, limit=20, page_no=1, **kw):
    data = {"pagination": {"total": len(results) if total is None else total, "offset": offset, "limit": limit}, "results": results}
    return page(C.MAIN_SOURCE, "search", queries("estatesSearch", data), tx=tx, page_no=page_no, **kw)


def detail_data(**over):
    data = {
        "name": "Byt", "description": "Popis.", "priceCzk": 20000, "priceCzkPerSqM": 400,
        "categoryTypeCb": {"value": 2}, "categorySubCb": {"name": "2+kk"},
        "images": [], "seller": {"name": "Agent"}, "premise": {"name": "Office"},
        "locality": {"street": "Dlouhá", "cityPart": "Vysočany", "city": "Praha", "district": "Praha 9", "latitude": 50.11, "longitude": 14.51},
        "params": {"costOfLiving": "3400", "floorArea": 50, "floorNumber": 2, "floors": 5, "garage": None, "parkingLots": 0, "parking": True, "refundableDeposit": 40000},
    }
    for name, value in over.items():
        if name in data["params"]:
            data["params"][name] = value
        else:
            data[name] = value
    return data


def detail(key, kind="detail", status=200, body=None, **over):
    kw = {k: over.pop(k) for k in ("run_id", "run_seq", "at", "url") if k in over}
    if body is None:
        body = queries("estate", detail_data(**over)) if status == 200 else ""
    return page(C.MAIN_SOURCE, kind, body, key=str(key), status=status, **kw)


def advert(id, **over):
    node = {
        "__typename": "Advert", "id": id, "disposition": "DISP_2_KK", "offerType": "PRONAJEM", "price": 18900,
        "surface": 33, "gps": {"lat": 50.1045, "lng": 14.507}, "active": True, "archived": False,
        "uri": f"advert-{id}", "mainImage": {"__ref": f"Image:{id}"},
    }
    node.update(over)
    return node


def image(id, thumb=None, main=None):
    node = {"__typename": "Image", "id": id}
    if thumb:
        node['url({"filter":"RECORD_THUMB"})'] = thumb
    if main:
        node['url({"filter":"RECORD_MAIN"})'] = main
    return node


def node_page(state, kind="search", tx="pronajem", page_no=1, key=None, **kw):
    return page(C.NODE_SOURCE, kind, embed(state), tx=tx, page_no=page_no, key=key, **kw)


def card(slug="praha-9/vysocany/62af01", title="pronájem bytu 2+kk 54,5 m²", price="23 400 Kč", info="Praha 9 - Vysočany", image="https://1gr.cz/x.jpg", host="https://reality.idnes.cz/detail/pronajem"):
    return (
        f'<div class="c-products__item"><a href="{host}/{slug}/"><img alt="" src="https://logo.example/i.png">'
        f'<img data-src="{image}"></a><h2 class="c-products__title x">{title}</a>'
        f'<p class="c-products__info">{info}</p><p class="c-products__price"><strong>{price}</strong></p></div>'
    )


def card_page(cards, tx="pronajem", closed=True, **kw):
    body = "<main>" + "".join(cards) + ("</main>" if closed else "")
    return page(C.CARD_SOURCE, "search", body, tx=tx, **kw)
